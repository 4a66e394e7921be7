"""Metrics, curves, run tables, sampling, splits, and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import OBJECTS_SQL, labelled_objects, q, query, scratch, stored, table
from starloom.functions import quantise
from starloom.operators import metrics as M
from starloom.operators import profile, sampling, spatial
from starloom.operators.metrics import METRIC_NAMES
from starloom.sources import runs as R


def c(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


# Two scores for one target over two groups of rows, so that metric tables have models and splits.
SCORES_SQL = """
sc AS (SELECT event_id, (event_type = 'purchase' OR (event_type = 'click' AND user_id < 75))::INTEGER AS y,
         CASE WHEN user_id < 75 THEN 'near' ELSE 'far' END AS split, value FROM events),
s AS (SELECT y, split, 'plain' AS model, least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS score FROM sc
      UNION ALL SELECT y, split, 'coarse', floor(least(value / 200.0::DOUBLE, 1.0::DOUBLE) * 20) / 20 FROM sc)"""

TOTALS_SQL = SCORES_SQL + """,
t AS (SELECT model, split, score, sum(y)::BIGINT AS tp, sum(1 - y)::BIGINT AS fp FROM s GROUP BY ALL),
u AS (SELECT *, sum(tp) OVER w::DOUBLE AS ctp, sum(fp) OVER w::DOUBLE AS cfp, sum(tp) OVER g::DOUBLE AS p, sum(fp) OVER g::DOUBLE AS n
      FROM t WINDOW w AS (PARTITION BY model, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
                    g AS (PARTITION BY model, split)),
k AS (SELECT model, split, sum(tp * ctp / (ctp + cfp)) / any_value(p) AS ap,
        sum(fp * (ctp - tp / 2.0::DOUBLE)) / (any_value(p) * any_value(n)) AS auc FROM u GROUP BY ALL),
x AS (SELECT model, split, sum(y * (score >= 0.3)::INTEGER)::DOUBLE AS tp, sum((1 - y) * (score >= 0.3)::INTEGER)::DOUBLE AS fp,
        sum(y * (score < 0.3)::INTEGER)::DOUBLE AS fn, sum((1 - y) * (score < 0.3)::INTEGER)::DOUBLE AS tn FROM s GROUP BY ALL)"""


def scores(spark, sf):
    ev = table(spark, sf, "events")
    base = ev.select(
        ((F.col("event_type") == "purchase") | ((F.col("event_type") == "click") & (F.col("user_id") < 75)))
        .cast("int").alias("y"),
        F.when(F.col("user_id") < 75, "near").otherwise("far").alias("split"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("score"),
    )
    plain = base.withColumn("model", F.lit("plain"))
    coarse = base.withColumns({"model": F.lit("coarse"), "score": F.floor(F.col("score") * 20).cast("double") / 20.0})
    return plain.unionByName(coarse)


def rounded(df, names, digits=6):
    return df.withColumns({n: quantise(n, digits) for n in names})


METRICS_SQL = f"""WITH {TOTALS_SQL}
SELECT k.model, k.split, {q('ap', 6)} AS test_average_precision, {q('auc', 6)} AS test_roc_auc,
  {q('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 6)} AS test_f1, {q('coalesce(tp / nullif(tp + fp, 0), 0)', 6)} AS test_precision,
  {q('coalesce(tp / nullif(tp + fn, 0), 0)', 6)} AS test_recall, {q('coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)', 6)} AS test_f1_genuine,
  {q('coalesce(tn / nullif(tn + fn, 0), 0)', 6)} AS test_precision_genuine, {q('coalesce(tn / nullif(tn + fp, 0), 0)', 6)} AS test_recall_genuine
FROM k JOIN x ON k.model = x.model AND k.split = x.split"""


@query("classifier_metrics", METRICS_SQL)
def classifier_metrics(spark, sf):
    return rounded(M.compute_metrics(scores(spark, sf), "y", "score", ["model", "split"], 0.3), METRIC_NAMES)


@query("ranking_metrics_all_rows", f"""
WITH s AS (SELECT (event_type = 'purchase')::INTEGER AS y, value AS score FROM events),
t AS (SELECT score, sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS fp FROM s GROUP BY score),
u AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM t WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT {q('sum(tp * ctp / (ctp + cfp)) / sum(tp)', 6)} AS average_precision,
  {q('sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp))', 6)} AS roc_auc FROM u""")
def ranking_metrics_all_rows(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.col("value").alias("score"))
    return rounded(M.ranking_metrics(rows, "y", "score"), ["average_precision", "roc_auc"])


@query("threshold_metrics", f"""WITH {TOTALS_SQL}
SELECT model, {q('2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))', 6)} AS test_f1, {q('sum(tp) / (sum(tp) + sum(fp))', 6)} AS test_precision,
  {q('sum(tp) / (sum(tp) + sum(fn))', 6)} AS test_recall, {q('2 * sum(tn) / (2 * sum(tn) + sum(fp) + sum(fn))', 6)} AS test_f1_genuine,
  {q('sum(tn) / (sum(tn) + sum(fn))', 6)} AS test_precision_genuine, {q('sum(tn) / (sum(tn) + sum(fp))', 6)} AS test_recall_genuine
FROM x GROUP BY model""")
def threshold_metrics(spark, sf):
    rows = scores(spark, sf).withColumn("pred", M.predicted_class("score", 0.3))
    return rounded(M.threshold_metrics(rows, "y", "pred", ["model"]), METRIC_NAMES[2:])


@query("pr_roc_curves", f"""WITH {TOTALS_SQL}
SELECT model, split, {q('score', 9)} AS score, {q('ctp / (ctp + cfp)', 6)} AS "precision", {q('ctp / p', 6)} AS recall,
  {q('cfp / n', 6)} AS fpr, {q('p / (p + n)', 6)} AS prevalence FROM u""")
def pr_roc_curves(spark, sf):
    out = M.pr_roc_curves(scores(spark, sf), "y", "score", ["model", "split"])
    return rounded(out, ["precision", "recall", "fpr", "prevalence"]).withColumn("score", quantise("score", 9))


@query("confusion_matrix", f"""WITH {SCORES_SQL},
z AS (SELECT model, y AS actual, (score >= 0.3)::INTEGER AS predicted, count(*) AS n FROM s GROUP BY ALL)
SELECT model, actual, predicted, n, {q('n::DOUBLE / sum(n) OVER (PARTITION BY model, actual)', 6)} AS row_share FROM z""")
def confusion_matrix(spark, sf):
    rows = scores(spark, sf).withColumn("pred", M.predicted_class("score", 0.3))
    return rounded(M.confusion_matrix(rows, "y", "pred", ["model"]), ["row_share"])


def run_log(spark, sf):
    """The scored models as a run log, written and read back."""
    table_rows = M.compute_metrics(scores(spark, sf), "y", "score", ["model", "split"], 0.3)
    log = R.runs_from_metrics(table_rows, "model", "split", METRIC_NAMES)
    path = scratch(spark)
    log.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("run_log_by_split", f"""WITH m AS ({METRICS_SQL})
SELECT model, test_average_precision, test_roc_auc, test_f1, test_recall_genuine FROM m WHERE split = 'near'""")
def run_log_by_split(spark, sf):
    names = ["test_average_precision", "test_roc_auc", "test_f1", "test_recall_genuine", "test_not_logged"]
    return rounded(R.split_metrics(run_log(spark, sf), "near", names), names[:4])


@query("generalisation_table", f"""WITH m AS ({METRICS_SQL})
SELECT model, split, test_average_precision AS avg_precision, test_roc_auc AS roc_auc, test_f1 AS f1, test_f1_genuine AS f1_genuine FROM m""")
def generalisation_table(spark, sf):
    return rounded(R.generalisation_table(run_log(spark, sf)), ["avg_precision", "roc_auc", "f1", "f1_genuine"])


@query("metric_pivot", f"""WITH m AS ({METRICS_SQL})
SELECT model, max(CASE WHEN split = 'near' THEN test_roc_auc END) AS near, max(CASE WHEN split = 'far' THEN test_roc_auc END) AS far
FROM m GROUP BY model""")
def metric_pivot(spark, sf):
    wide = profile.pivot_metric(R.generalisation_table(run_log(spark, sf)), "model", "split", "roc_auc", ["near", "far"])
    return rounded(wide, ["near", "far"])


@query("metric_drop", f"""WITH {TOTALS_SQL}
SELECT a.model, {q('a.ap', 6)} AS near, {q('b.ap', 6)} AS far, {q('a.ap - b.ap', 6)} AS "drop"
FROM k a JOIN k b ON a.model = b.model WHERE a.split = 'near' AND b.split = 'far'""")
def metric_drop(spark, sf):
    table_rows = R.generalisation_table(run_log(spark, sf))
    return rounded(profile.metric_drop(table_rows, "model", "split", "avg_precision", "near", "far"), ["near", "far", "drop"])


# ---- splits and samples ---------------------------------------------------------------------

SEED = 1122334455


def _roles_sql(source: str, strata: str, key: str, val_only: bool) -> str:
    """Largest-remainder class quotas and md5 order, written out as windows."""
    quota = """
  floor({want} * n_class / n_pool) + (row_number() OVER (ORDER BY (({want} * n_class) % n_pool) DESC, cls::VARCHAR)
    <= {want} - sum(floor({want} * n_class / n_pool)) OVER ())::INTEGER"""
    test = "0" if val_only else f"({quota.format(want='n_test')})"
    n_test = "0" if val_only else "ceil(0.2::DOUBLE * n)"
    n_val = "ceil(0.2::DOUBLE * n)" if val_only else "ceil(0.25::DOUBLE * (n - ceil(0.2::DOUBLE * n)))"
    return f"""
d AS ({source}),
cls AS (SELECT {strata} AS cls, count(*)::BIGINT AS n_class FROM d GROUP BY 1),
tot AS (SELECT *, (sum(n_class) OVER ())::BIGINT AS n FROM cls),
w1 AS (SELECT *, n AS n_pool, ({n_test})::BIGINT AS n_test, ({n_val})::BIGINT AS n_val FROM tot),
w2 AS (SELECT cls, n_class AS n_all, ({test})::BIGINT AS q_test, n_val FROM w1),
w3 AS (SELECT cls, q_test, n_val AS n_test, n_all - q_test AS n_class, (sum(n_all - q_test) OVER ())::BIGINT AS n_pool FROM w2),
w4 AS (SELECT cls, q_test, ({quota.format(want='n_test')})::BIGINT AS q_val FROM w3),
o AS (SELECT d.*, row_number() OVER (PARTITION BY {strata} ORDER BY md5('{SEED}|' || {key})) AS k FROM d),
roles AS (SELECT o.*, CASE WHEN k <= q_test THEN 'test' WHEN k <= q_test + q_val THEN 'val' ELSE 'train' END AS split_role
          FROM o JOIN w4 ON o.{strata} IS NOT DISTINCT FROM w4.cls)"""


@query("stratified_three_way_split", "WITH " + _roles_sql(
    "SELECT c_custkey, c_mktsegment FROM customer", "c_mktsegment", "c_custkey::VARCHAR", False
) + " SELECT c_custkey, c_mktsegment, split_role FROM roles")
def stratified_three_way_split(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return sampling.stratified_three_way(rows, "c_mktsegment", ["c_custkey"], SEED, 0.6, 0.2)


@query("stratified_label_split", f"WITH {OBJECTS_SQL}, " + _roles_sql(
    "SELECT object_id, population, by_match FROM lab", "by_match", "object_id::VARCHAR", False
) + " SELECT object_id, by_match, split_role FROM roles")
def stratified_label_split(spark, sf):
    rows = stored(spark, labelled_objects(spark, sf).where(F.col("by_match").isNotNull()).select("object_id", "by_match"))
    return sampling.stratified_three_way(rows, "by_match", ["object_id"], SEED, 0.6, 0.2)


CROSS_SQL = _roles_sql(
    "SELECT o_orderkey, o_orderstatus, o_totalprice > 150000 AS y FROM orders WHERE o_orderstatus = 'F'",
    "y", "o_orderkey::VARCHAR", True)


@query("cross_population_split", f"""WITH {CROSS_SQL}
SELECT o_orderkey, o_orderstatus, y, split_role FROM roles
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice > 150000, 'test' FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def cross_population_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 150000).alias("y"))
    return sampling.cross_population_split(rows, "o_orderstatus", ["F"], ["O", "P"], "y", ["o_orderkey"], SEED, 0.2)


@query("split_scenarios", "WITH " + _roles_sql(
    "SELECT o_orderkey, o_orderstatus, o_totalprice > 150000 AS y FROM orders WHERE o_orderstatus = 'F'",
    "y", "o_orderkey::VARCHAR", False) + f""",
c AS (WITH {CROSS_SQL} SELECT o_orderkey, o_orderstatus, y, split_role FROM roles),
every AS (SELECT 'within' AS split_name, o_orderstatus, y, split_role FROM roles
  UNION ALL SELECT 'to_open', o_orderstatus, y, split_role FROM c
  UNION ALL SELECT 'to_open', o_orderstatus, o_totalprice > 150000, 'test' FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'to_pending', o_orderstatus, y, split_role FROM c
  UNION ALL SELECT 'to_pending', o_orderstatus, o_totalprice > 150000, 'test' FROM orders WHERE o_orderstatus = 'P')
SELECT split_name, split_role, o_orderstatus, count(*) AS n, {c('y')} AS n_positive FROM every GROUP BY split_name, split_role, o_orderstatus""")
def split_scenarios(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 150000).alias("y"))
    within = sampling.stratified_three_way(rows.where(F.col("o_orderstatus") == "F"), "y", ["o_orderkey"], SEED, 0.6, 0.2)
    parts = [within.withColumn("split_name", F.lit("within"))]
    for name, status in (("to_open", "O"), ("to_pending", "P")):
        cross = sampling.cross_population_split(rows, "o_orderstatus", ["F"], [status], "y", ["o_orderkey"], SEED, 0.2)
        parts.append(cross.withColumn("split_name", F.lit(name)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return profile.conditional_counts(every, ["split_name", "split_role", "o_orderstatus"], {"n_positive": F.col("y")})


@query("stratified_sample", """
WITH n AS (SELECT o_orderstatus AS s, least(round_even(count(*)::DOUBLE / (SELECT count(*) FROM orders) * 1000, 0), count(*)) AS quota
  FROM orders GROUP BY 1),
o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey::VARCHAR)) AS k FROM orders)
SELECT o_orderkey, o_orderstatus FROM o JOIN n ON s = o_orderstatus WHERE k <= quota""")
def stratified_sample(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_sample(rows, "o_orderstatus", ["o_orderkey"], 1000, 42)


@query("fixed_size_sample", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY md5('42|' || o_orderkey::VARCHAR) LIMIT 200""")
def fixed_size_sample(spark, sf):
    rows = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    return sampling.fixed_size_sample(rows, ["o_orderkey"], 200, 42)


# ---- neighbours -----------------------------------------------------------------------------

BOX, RADIUS = 0.25, 0.06


def positions(spark, sf):
    at = [F.pmod(F.element_at("embedding", i + 1).cast("double") + 0.5, F.lit(BOX)).alias(n) for i, n in enumerate("xyz")]
    return table(spark, sf, "embeddings").select("vec_id", "label", *at, F.lit(BOX).alias("box"))


NEIGHBOUR_SQL = """
WITH p AS (SELECT vec_id, label, (embedding[1]::DOUBLE + 0.5) % 0.25::DOUBLE AS x, (embedding[2]::DOUBLE + 0.5) % 0.25::DOUBLE AS y,
    (embedding[3]::DOUBLE + 0.5) % 0.25::DOUBLE AS z FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.vec_id IS NOT NULL AS seen,
    pow(least(abs(a.x - b.x), 0.25::DOUBLE - abs(a.x - b.x)), 2) + pow(least(abs(a.y - b.y), 0.25::DOUBLE - abs(a.y - b.y)), 2)
      + pow(least(abs(a.z - b.z), 0.25::DOUBLE - abs(a.z - b.z)), 2) AS d2
  FROM p a LEFT JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


@query("periodic_neighbours", NEIGHBOUR_SQL + f"""
SELECT vec_id, label, {q('sqrt(min(d2))', 6)} AS nearest, {c(f'd2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE')} AS n_within FROM d GROUP BY ALL""")
def periodic_neighbours(spark, sf):
    out = spatial.periodic_neighbours(positions(spark, sf), "label", ["vec_id"], ["x", "y", "z"], "box", RADIUS)
    return out.withColumn("nearest", quantise("nearest", 6))


@query("nearest_distance", NEIGHBOUR_SQL + f" SELECT vec_id, label, {q('sqrt(min(d2))', 6)} AS nearest FROM d GROUP BY ALL")
def nearest_distance(spark, sf):
    out = spatial.nearest_distance(positions(spark, sf), "label", ["vec_id"], ["x", "y", "z"], "box")
    return out.withColumn("nearest", quantise("nearest", 6))


@query("radius_count", NEIGHBOUR_SQL + f"""
SELECT vec_id, label, {c(f'd2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE')} AS n_within FROM d GROUP BY ALL""")
def radius_count(spark, sf):
    return spatial.radius_count(positions(spark, sf), "label", ["vec_id"], ["x", "y", "z"], "box", RADIUS)
