"""Feature preparation, classifiers, and explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import OBJECTS_SQL, labelled_objects, q, query, scratch, stored, table
from starloom.functions import log10_positive, missing_flag, quantise
from starloom.operators import explain as E
from starloom.operators import models as L
from starloom.operators import profile
from starloom.operators.metrics import METRIC_NAMES, compute_metrics
from starloom.operators.sampling import fixed_size_sample, stratified_sample, stratified_three_way
from starloom.plans.training import train_split
from starloom.sources.runs import run_row

SEED = 1122334455
FEATURES = ["log_mass", "n_lines", "avg_qty", "avg_disc", "shape", "log_rec"]
NULLABLE = ["shape", "log_rec"]
KEY = ["object_id"]

FEATURES_SQL = f"""{OBJECTS_SQL},
agg AS (SELECT l_orderkey AS object_id, count(*)::DOUBLE AS n_lines, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc
        FROM lineitem GROUP BY l_orderkey),
feat AS (SELECT object_id, log10(mass) AS log_mass, coalesce(n_lines, 0) AS n_lines, coalesce(avg_qty, 0) AS avg_qty,
  coalesce(avg_disc, 0) AS avg_disc, shape, log10(rec_mass) AS log_rec, by_match FROM lab LEFT JOIN agg USING (object_id))"""


def feature_rows(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("object_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.avg("l_quantity").alias("avg_qty"),
        F.avg("l_discount").alias("avg_disc"),
    )
    rows = labelled_objects(spark, sf).join(lines, "object_id", "left").fillna(0.0, ["n_lines", "avg_qty", "avg_disc"])
    return rows.withColumns({"log_mass": log10_positive("mass"), "log_rec": log10_positive("rec_mass")}).select(
        "object_id", *FEATURES, "by_match"
    )


def split_rows(spark, sf) -> DataFrame:
    """Prepared rows with their role, written once so that every fit reads a table."""
    rows = stored(spark, feature_rows(spark, sf))
    placed = stratified_three_way(rows, "by_match", KEY, SEED, 0.6, 0.2)
    return stored(spark, L.prepared(placed, FEATURES, "by_match", ["object_id", "split_role"]))


# ---- preparation ----------------------------------------------------------------------------


@query("zero_fill_with_indicators", f"""WITH {FEATURES_SQL}
SELECT object_id, {q('log_mass', 6)} AS log_mass, {q('coalesce(shape, 0)', 6)} AS shape, {q('coalesce(log_rec, 0)', 6)} AS log_rec,
  (shape IS NULL)::INTEGER::DOUBLE AS shape_missing, (log_rec IS NULL)::INTEGER::DOUBLE AS log_rec_missing FROM feat""")
def zero_fill_with_indicators(spark, sf):
    out = L.with_missing_flags(feature_rows(spark, sf), NULLABLE, FEATURES)
    return out.select(
        "object_id", *[quantise(n, 6).alias(n) for n in ("log_mass", "shape", "log_rec")],
        "shape_missing", "log_rec_missing",
    )


SCALED_SQL = f"""WITH {FEATURES_SQL},
tr AS (SELECT feat.* FROM feat JOIN orders ON object_id = o_orderkey WHERE o_orderdate < TIMESTAMP '1996-01-01'),
mu AS (SELECT avg(shape) AS m_shape, avg(log_rec) AS m_rec, avg(log_mass) AS m_mass FROM tr),
sd AS (SELECT stddev_samp(coalesce(shape, m_shape)) AS s_shape, stddev_samp(coalesce(log_rec, m_rec)) AS s_rec,
        stddev_samp(log_mass) AS s_mass FROM tr, mu)"""


def _scaled(spark, sf) -> DataFrame:
    rows = feature_rows(spark, sf)
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"), "o_orderdate")
    train = rows.join(dates, "object_id").where(F.col("o_orderdate") < "1996-01-01")
    chosen = ["shape", "log_rec", "log_mass"]
    fitted = Pipeline(stages=L.imputing_stages(chosen, scale=True)).fit(train)
    return fitted.transform(rows).withColumn("v", vector_to_array(L.VECTOR))


@query("imputed_and_scaled_vector", SCALED_SQL + f"""
SELECT object_id, {q('(coalesce(shape, m_shape) - m_shape) / s_shape', 6)} AS v0,
  {q('(coalesce(log_rec, m_rec) - m_rec) / s_rec', 6)} AS v1, {q('(log_mass - m_mass) / s_mass', 6)} AS v2 FROM feat, mu, sd""")
def imputed_and_scaled_vector(spark, sf):
    return _scaled(spark, sf).select("object_id", *[quantise(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in range(3)])


@query("mean_imputed_columns", SCALED_SQL + f"""
SELECT object_id, {q('coalesce(shape, m_shape)', 6)} AS shape, {q('coalesce(log_rec, m_rec)', 6)} AS log_rec FROM feat, mu""")
def mean_imputed_columns(spark, sf):
    return _scaled(spark, sf).select(
        "object_id", quantise("shape__filled", 6).alias("shape"), quantise("log_rec__filled", 6).alias("log_rec")
    )


@query("balanced_row_weights", f"""WITH {FEATURES_SQL}
SELECT object_id, {q('count(*) OVER ()::DOUBLE / (2 * count(*) OVER (PARTITION BY by_match))', 6)} AS weight FROM feat""")
def balanced_row_weights(spark, sf):
    rows = L.prepared(feature_rows(spark, sf), FEATURES, "by_match", KEY)
    return L.with_class_weight(rows, "balanced").select("object_id", quantise("weight", 6).alias("weight"))


@query("oversampled_rows", """
WITH d AS (SELECT o_orderkey, (o_totalprice > 300000)::INTEGER::DOUBLE AS label FROM orders),
n AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS z FROM d),
r AS (SELECT *, p < z AS small_is_one, greatest(p, z)::DOUBLE / least(p, z) AS ratio FROM n),
t AS (SELECT o_orderkey, label, CASE WHEN (label = 1) = small_is_one THEN floor(ratio)
   + (('0x' || substr(md5('55667788|' || o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < ratio - floor(ratio))::INTEGER
   ELSE 1 END AS times FROM d, r)
SELECT o_orderkey, label, times::BIGINT AS copies FROM t""")
def oversampled_rows(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 300000).cast("double").alias("label"))
    return L.oversampled(rows, ["o_orderkey"]).groupBy("o_orderkey", "label").agg(F.count(F.lit(1)).alias("copies"))


# ---- classifiers (rows only: iterative fits have no SQL form) --------------------------------

# Smaller grids than the library's, so that a check stays short.
SHORT_GRIDS = {
    "lr": {"C": [0.1, 1.0], "l1_ratio": [0.0, 0.5], "class_weight": [None, "balanced"]},
    "rf": {"n_estimators": [20], "max_depth": [5, 8], "min_samples_leaf": [5], "max_features": ["sqrt"],
           "class_weight": [None], "ccp_alpha": [0.0]},
    "gbm": {"max_iter": [10], "max_depth": [3, 5], "learning_rate": [0.1], "min_samples_leaf": [20], "class_weight": [None]},
}
SHORT_ITERATIONS = {"max_iterations": 60, "every": 10, "patience": 2}


def _results(spark, split, results) -> DataFrame:
    rows = [run_row(spark, name, split, params, metrics) for name, (params, metrics) in results.items()]
    return reduce(DataFrame.unionByName, rows)


def _sweep(spark, sf, models, networks) -> DataFrame:
    results = train_split(
        split_rows(spark, sf), "within", models, networks, columns=FEATURES, nullable=NULLABLE, key=KEY,
        grids=SHORT_GRIDS, iterations=SHORT_ITERATIONS, parallelism=4,
    )
    log = _results(spark, "within", results)
    return log.select("model", "split_name", *[F.col("metrics")[m].alias(m) for m in METRIC_NAMES])


@query("model_logistic")
def model_logistic(spark, sf):
    return _sweep(spark, sf, "lr", [])


@query("model_forest")
def model_forest(spark, sf):
    return _sweep(spark, sf, "rf", [])


@query("model_boosted")
def model_boosted(spark, sf):
    return _sweep(spark, sf, "gbm", [])


@query("model_ensemble")
def model_ensemble(spark, sf):
    return _sweep(spark, sf, "all", [])


@query("model_network_impute")
def model_network_impute(spark, sf):
    return _sweep(spark, sf, [], "mlp_impute")


@query("model_network_mask")
def model_network_mask(spark, sf):
    return _sweep(spark, sf, [], "mlp_mask")


@query("grid_search_history")
def grid_search_history(spark, sf):
    """Every grid point with its validation average precision."""
    fitted = L.tune("lr", L.Roles.of(split_rows(spark, sf)), FEATURES, SHORT_GRIDS["lr"], parallelism=4)
    rows = [(p["C"], p["l1_ratio"], p["class_weight"], score, p == fitted.params) for p, score in fitted.history]
    return spark.createDataFrame(rows, "c double, l1_ratio double, class_weight string, val_ap double, chosen boolean")


def _plain_model(rows: DataFrame):
    return L.fit_one("lr", rows.where(F.col("split_role") == "train"), FEATURES, {"C": 1.0, "l1_ratio": 0.0})


@query("saved_model_scores")
def saved_model_scores(spark, sf):
    """Scores of the test role by a model that was saved and loaded."""
    rows = split_rows(spark, sf)
    path = scratch(spark)
    L.save_model(_plain_model(rows), path)
    test = rows.where(F.col("split_role") == "test")
    return L.positive_probability(L.load_model(path), test).select("object_id", "label", "score")


@query("soft_vote_metrics")
def soft_vote_metrics(spark, sf):
    rows = split_rows(spark, sf)
    train = rows.where(F.col("split_role") == "train")
    fits = {
        "lr": L.fit_one("lr", train, FEATURES, {"C": 1.0, "l1_ratio": 0.0}),
        "rf": L.fit_one("rf", train, FEATURES, {k: v[0] for k, v in SHORT_GRIDS["rf"].items()}),
    }
    voted = L.soft_vote(fits, rows.where(F.col("split_role") == "test"))
    return compute_metrics(voted.select("label", "score"), "label", "score")


# ---- explanations ---------------------------------------------------------------------------

COEFFICIENTS = {"l_quantity": 0.8, "l_discount": -30.0, "l_tax": 12.5, "l_extendedprice": 0.0005, "l_linenumber": 0.02}
LINE_KEY = ["l_orderkey", "l_returnflag", "l_linestatus"]


def _line_contributions(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, *COEFFICIENTS)
    means = profile.column_means(lines.where(F.col("l_linestatus") == "F"), list(COEFFICIENTS))
    return E.linear_contributions(lines, LINE_KEY, COEFFICIENTS, means)


LINE_SQL = "WITH mu AS (SELECT " + ", ".join(
    f"avg({k}) AS m_{k}" for k in COEFFICIENTS
) + " FROM lineitem WHERE l_linestatus = 'F'), con AS (" + " UNION ALL ".join(
    f"SELECT {', '.join(LINE_KEY)}, '{k}' AS feature, {k}::DOUBLE AS value, {v!r}::DOUBLE * ({k} - m_{k}) AS contribution FROM lineitem, mu"
    for k, v in COEFFICIENTS.items()) + ")"
IMPORTANCE_SQL = LINE_SQL + ", imp AS (SELECT feature, avg(abs(contribution)) AS raw FROM con GROUP BY feature), " \
    "imn AS (SELECT feature, raw / sum(raw) OVER () AS importance FROM imp)"

EVENT_COEFFICIENTS = {"value": 0.05, "user_id": -0.01}


@query("linear_contributions", f"""
WITH mu AS (SELECT avg(value) AS mv, avg(user_id) AS mu FROM events WHERE event_type = 'view')
SELECT event_id, 'value' AS feature, {q('value', 4)} AS value, {q('0.05::DOUBLE * (value - mv)', 6)} AS contribution FROM events, mu
UNION ALL SELECT event_id, 'user_id', user_id::DOUBLE, {q('-0.01::DOUBLE * (user_id - mu)', 6)} FROM events, mu""")
def linear_contributions(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    means = profile.column_means(ev.where(F.col("event_type") == "view"), list(EVENT_COEFFICIENTS))
    out = E.contribution_points(E.linear_contributions(ev, ["event_id"], EVENT_COEFFICIENTS, means), ["event_id"])
    return out.withColumns({"value": quantise("value", 4), "contribution": quantise("contribution", 6)})


@query("feature_importance", IMPORTANCE_SQL + f" SELECT feature, {q('importance', 6)} AS importance, (row_number() OVER (ORDER BY importance DESC))::INTEGER AS rank FROM imn")
def feature_importance(spark, sf):
    out = E.ranked(E.importance(_line_contributions(spark, sf)))
    return out.withColumn("importance", quantise("importance", 6))


@query("top_features", IMPORTANCE_SQL + f" SELECT feature, {q('importance', 6)} AS importance FROM imn ORDER BY imn.importance DESC LIMIT 4")
def top_features(spark, sf):
    return E.top_features(E.importance(_line_contributions(spark, sf))).withColumn("importance", quantise("importance", 6))


@query("importance_by_split", LINE_SQL + f""",
imp AS (SELECT l_returnflag, feature, avg(abs(contribution)) AS raw FROM con GROUP BY ALL),
imn AS (SELECT *, raw / sum(raw) OVER (PARTITION BY l_returnflag) AS importance FROM imp),
w AS (SELECT feature, max(importance) FILTER (WHERE l_returnflag = 'N') AS N, max(importance) FILTER (WHERE l_returnflag = 'A') AS A,
   max(importance) FILTER (WHERE l_returnflag = 'R') AS R FROM imn GROUP BY feature)
SELECT feature, {q('N', 6)} AS N, {q('A', 6)} AS A, {q('R', 6)} AS R, (row_number() OVER (ORDER BY w.N DESC))::INTEGER AS rank FROM w""")
def importance_by_split(spark, sf):
    out = E.importance_matrix(_line_contributions(spark, sf), "l_returnflag", ["N", "A", "R"], "N")
    return out.withColumns({n: quantise(n, 6) for n in ("N", "A", "R")})


@query("importance_by_flag", LINE_SQL + f""",
imp AS (SELECT l_linestatus, feature, avg(abs(contribution)) AS raw FROM con GROUP BY ALL),
imn AS (SELECT *, raw / sum(raw) OVER (PARTITION BY l_linestatus) AS v FROM imp)
SELECT feature, {q("max(v) FILTER (WHERE l_linestatus = 'F')", 6)} AS host, {q("max(v) FILTER (WHERE l_linestatus <> 'F')", 6)} AS sub,
  {q("max(v) FILTER (WHERE l_linestatus = 'F') - max(v) FILTER (WHERE l_linestatus <> 'F')", 6)} AS difference FROM imn GROUP BY feature""")
def importance_by_flag(spark, sf):
    con = _line_contributions(spark, sf).withColumn("is_host", F.col("l_linestatus") == "F")
    return E.flag_importance(con, "is_host").withColumns({n: quantise(n, 6) for n in ("host", "sub", "difference")})


@query("dependence_points", f"""
WITH mu AS (SELECT avg(value) AS mv, avg(user_id) AS mu FROM events),
con AS (SELECT event_id, 'value' AS feature, value, 0.05::DOUBLE * (value - mv) AS c, user_id::DOUBLE AS other FROM events, mu
  UNION ALL SELECT event_id, 'user_id', user_id::DOUBLE, -0.01::DOUBLE * (user_id - mu), value FROM events, mu)
SELECT event_id, feature, {q('value', 4)} AS value, {q('c', 6)} AS contribution,
  CASE feature WHEN 'value' THEN 'user_id' ELSE 'value' END AS colour_feature, {q('other', 4)} AS colour_value FROM con""")
def dependence_points(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value", "user_id")
    con = E.linear_contributions(ev, ["event_id"], EVENT_COEFFICIENTS, profile.column_means(ev, list(EVENT_COEFFICIENTS)))
    out = E.dependence_points(con, ["event_id"], k=4)
    return out.withColumns({
        "value": quantise("value", 4), "contribution": quantise("contribution", 6), "colour_value": quantise("colour_value", 4),
    })


@query("indicator_importance", f"""
WITH d AS (SELECT coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic,
  (quality IS NULL)::INTEGER::DOUBLE AS qm, (toxic IS NULL)::INTEGER::DOUBLE AS tm FROM documents LEFT JOIN labels USING (doc_id)),
mu AS (SELECT avg(quality) AS a, avg(toxic) AS b, avg(qm) AS c, avg(tm) AS e FROM d)
SELECT 'quality' AS feature, {q('avg(abs(0.7::DOUBLE * (quality - a)))', 6)} AS feature_importance,
  {q('avg(abs(0.2::DOUBLE * (qm - c)))', 6)} AS indicator_importance FROM d, mu
UNION ALL SELECT 'toxic', {q('avg(abs(-1.1::DOUBLE * (toxic - b)))', 6)}, {q('avg(abs(0.4::DOUBLE * (tm - e)))', 6)} FROM d, mu""")
def indicator_importance(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    flagged = rows.select(
        "doc_id", "quality", "toxic",
        missing_flag("quality").alias("quality_missing"), missing_flag("toxic").alias("toxic_missing"),
    ).fillna(0)
    coefficients = {"quality": 0.7, "toxic": -1.1, "quality_missing": 0.2, "toxic_missing": 0.4}
    con = E.linear_contributions(flagged, ["doc_id"], coefficients, profile.column_means(flagged, list(coefficients)))
    out = E.indicator_importance(con, ["quality", "toxic"])
    return out.withColumns({n: quantise(n, 6) for n in ("feature_importance", "indicator_importance")})


@query("sampled_contributions")
def sampled_contributions(spark, sf):
    """Contributions of a forest for every test row, with a 200-row background from train and val."""
    rows = split_rows(spark, sf)
    train = rows.where(F.col("split_role") != "test")
    means = train.agg(*[F.avg(c).alias(c) for c in FEATURES]).first().asDict()
    filled = rows.fillna(means)
    model = L.fit_one("rf", train, FEATURES, {k: v[0] for k, v in SHORT_GRIDS["rf"].items()}).stages[-1]

    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("score", vector_to_array("probability")[1])

    background = fixed_size_sample(filled.where(F.col("split_role") != "test"), KEY, 200, 42)
    return E.sampled_contributions(
        filled.where(F.col("split_role") == "test"), background, KEY, FEATURES, score, n_orders=4, vector=L.VECTOR
    )


@query("sampled_contributions_linear", f"""
WITH mu AS (SELECT avg(value) AS mv, avg(user_id) AS mu FROM events)
SELECT event_id, event_type = 'view' AS is_host, 'value' AS feature, {q('value', 4)} AS value, {q('0.05::DOUBLE * (value - mv)', 6)} AS contribution FROM events, mu
UNION ALL SELECT event_id, event_type = 'view', 'user_id', user_id::DOUBLE, {q('-0.01::DOUBLE * (user_id - mu)', 6)} FROM events, mu""")
def sampled_contributions_linear(spark, sf):
    """Against the mean row as background, the sampled values of a linear score are its exact ones."""
    ev = table(spark, sf, "events").select("event_id", (F.col("event_type") == "view").alias("is_host"), "value", "user_id")
    features = list(EVENT_COEFFICIENTS)

    def score(df: DataFrame) -> DataFrame:
        v = vector_to_array("features")
        return df.withColumn("score", v[0] * EVENT_COEFFICIENTS["value"] + v[1] * EVENT_COEFFICIENTS["user_id"])

    out = E.sampled_contributions(
        ev, profile.column_means(ev, features), ["event_id"], features, score, n_orders=2, carry=["is_host"]
    )
    return out.withColumns({"value": quantise("value", 4), "contribution": quantise("contribution", 6)})


@query("sampled_importance_of_subsample")
def sampled_importance_of_subsample(spark, sf):
    """Importance of a logistic model from a stratified subsample of the test role."""
    rows = split_rows(spark, sf)
    train = rows.where(F.col("split_role") != "test")
    means = train.agg(*[F.avg(c).alias(c) for c in FEATURES]).first().asDict()
    filled = rows.fillna(means)
    fitted = L.fit_one("lr", train, FEATURES, {"C": 1.0, "l1_ratio": 0.0})
    scaler, model = fitted.stages[-2], fitted.stages[-1]

    def score(df: DataFrame) -> DataFrame:
        return model.transform(scaler.transform(df)).withColumn("score", vector_to_array("probability")[1])

    sample = stratified_sample(filled.where(F.col("split_role") == "test"), "label", KEY, 500, 42)
    background = fixed_size_sample(filled.where(F.col("split_role") != "test"), KEY, 100, 42)
    con = E.sampled_contributions(sample, background, KEY, FEATURES, score, n_orders=4, vector="__raw")
    return E.ranked(E.importance(con))
