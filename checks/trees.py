"""Classifiers whose fit has a closed form, and exact explanations of tree ensembles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import q, query, scratch, stored, table
from checks.modelling import FEATURES, FEATURES_SQL, KEY, SHORT_GRIDS, feature_rows
from starloom.functions import quantise
from starloom.operators import explain as E
from starloom.operators import models as L
from starloom.operators import trees as T
from starloom.operators.boosting import HistogramBoosting

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "line"]
RATE, MIN_LEAF = 0.1, 20


def line_rows(spark, sf) -> DataFrame:
    """Returned or not, by four features, one of which is missing for every third line number."""
    line = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber"))
    rows = table(spark, sf, "lineitem").withColumn("line", line)
    return L.prepared(rows.withColumn("y", F.col("l_returnflag") == "R"), LINE_FEATURES, "y", ["l_orderkey"])


def _stump(rows: DataFrame) -> T.TreeModel:
    """One round of boosting with two leaves."""
    with L.prepared_vectors(rows, LINE_FEATURES, scale=False, fill=False) as (_, vectors):
        weighted = vectors.withColumn(L.WEIGHT, F.lit(1.0))
        return HistogramBoosting(1, None, RATE, MIN_LEAF, max_leaves=2).fit(weighted)


# Gradients are whole multiples of 2**-24 in both; the gain of every value of every feature, missing rows on either side.
STUMP_SQL = f"""
WITH d AS (SELECT (l_returnflag = 'R')::INTEGER AS y, l_quantity::DOUBLE AS f0, l_discount::DOUBLE AS f1, l_tax::DOUBLE AS f2,
                  CASE WHEN l_linenumber <> 3 THEN l_linenumber::DOUBLE END AS f3 FROM lineitem),
p AS (SELECT avg(y) AS p, count(*) AS n, sum(y) AS n1 FROM d),
u AS (SELECT round(p * 16777216) AS gz, round((p - 1) * 16777216) AS go, round(p * (1 - p) * 16777216) AS h, n, n1 FROM p),
long AS ({' UNION ALL '.join(f'SELECT {i} AS f, f{i} AS v, y FROM d' for i in range(4))}),
c AS (SELECT f, v, count(*) AS n, sum(y) AS n1 FROM long GROUP BY f, v),
cum AS (SELECT f, v, sum(n) OVER w AS n, sum(n1) OVER w AS n1 FROM c WHERE v IS NOT NULL
        WINDOW w AS (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING)),
miss AS (SELECT f, coalesce(sum(n) FILTER (v IS NULL), 0) AS mn, coalesce(sum(n1) FILTER (v IS NULL), 0) AS m1 FROM c GROUP BY f),
side AS (SELECT f, v, s, mn, cum.n + s * mn AS nl, cum.n1 + s * m1 AS n1l FROM cum JOIN miss USING (f), (SELECT unnest([0, 1]) AS s)),
sums AS (SELECT f, v, s, mn, nl, u.n - nl AS nr, ((nl - n1l) * gz + n1l * go) / 16777216 AS gl, nl * h / 16777216 AS hl,
                ((u.n - nl - u.n1 + n1l) * gz + (u.n1 - n1l) * go) / 16777216 AS gr, (u.n - nl) * h / 16777216 AS hr FROM side, u),
best AS (SELECT *, gl * gl / hl + gr * gr / hr - (gl + gr) * (gl + gr) / (hl + hr) AS gain FROM sums WHERE nl >= {MIN_LEAF} AND nr >= {MIN_LEAF}
         ORDER BY round(gain, 9) DESC, f, v, s LIMIT 1),
stump AS (SELECT f, v, CASE WHEN mn > 0 THEN s = 1 ELSE nl >= nr END AS missing_left, -{RATE} * gl / hl AS vl, -{RATE} * gr / hr AS vr, nl, nr FROM best)
"""


@query("boosted_one_round", STUMP_SQL + f"""
SELECT f::INTEGER AS feature, v AS threshold, missing_left, {q('vl', 9)} AS value_left, {q('vr', 9)} AS value_right,
  nl::DOUBLE AS n_left, nr::DOUBLE AS n_right FROM stump""")
def boosted_one_round(spark, sf):
    """The split that one round of boosting with two leaves chooses, and the outputs of its leaves."""
    t = _stump(stored(spark, line_rows(spark, sf))).tables()[0]
    i, j = int(t.left[0]), int(t.right[0])
    row = (int(t.feature[0]), float(t.threshold[0]), bool(t.missing_left[0]), float(t.value[i]), float(t.value[j]), float(t.cover[i]), float(t.cover[j]))
    out = spark.createDataFrame([row], "feature int, threshold double, missing_left boolean, value_left double, value_right double, n_left double, n_right double")
    return out.withColumns({n: quantise(n, 9) for n in ("value_left", "value_right")})


@query("boosted_contributions_one_split", STUMP_SQL + f""",
phi AS (SELECT CASE f WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS x, f, v, missing_left, vl, vr, (nl * vl + nr * vr) / (nl + nr) AS mean
        FROM d, stump),
own AS (SELECT f, CASE WHEN CASE WHEN x IS NULL THEN missing_left ELSE x <= v END THEN vl ELSE vr END - mean AS c FROM phi)
SELECT i::INTEGER AS feature, {q('CASE WHEN i = f THEN c ELSE 0 END', 9)} AS contribution, count(*) AS n_rows
FROM own, (SELECT unnest(range(4)) AS i) GROUP BY ALL""")
def boosted_contributions_one_split(spark, sf):
    """With one split, a row's contribution is its leaf's output less the mean output."""
    rows = stored(spark, line_rows(spark, sf))
    out = T.tree_contributions(rows, ["l_orderkey"], LINE_FEATURES, _stump(rows))
    number = F.array_position(F.array(*[F.lit(c) for c in LINE_FEATURES]), F.col("feature")) - 1
    # adding 0 turns a negative zero into zero
    counted = out.select(number.cast("int").alias("feature"), (quantise("contribution", 9) + F.lit(0.0)).alias("contribution"))
    return counted.groupBy("feature", "contribution").agg(F.count(F.lit(1)).alias("n_rows"))


def _contribution_gaps(spark, sf, name: str, link) -> DataFrame:
    """For every row, how far base and contributions are from the model's score."""
    rows = stored(spark, L.prepared(feature_rows(spark, sf).where("by_match is not null"), FEATURES, "by_match", KEY))
    means = rows.agg(*[F.avg(c).alias(c) for c in FEATURES]).first().asDict()
    params = {k: v[0] for k, v in SHORT_GRIDS[name].items()}
    fitted = L.fit_one(name, rows, FEATURES, params)
    model = L.as_trees(fitted.stages[-1])
    seen = rows if name in L.UNFILLED_MODELS else rows.fillna(means)
    # scored by the fitted model itself, explained by its node tables
    scored = L.positive_probability(fitted, rows).select(*KEY, link(F.col("score")).alias("raw"))
    sums = T.tree_contributions(seen, KEY, FEATURES, model).groupBy(*KEY).agg(F.sum("contribution").alias("s"))
    gap = F.abs(F.col("s") + F.lit(T.base_score(model)) - F.col("raw"))
    return sums.join(scored, KEY).select(*KEY, quantise(gap, 6).alias("gap"))


GAP_SQL = f"WITH {FEATURES_SQL} SELECT object_id, 0.0::DOUBLE AS gap FROM feat WHERE by_match IS NOT NULL"


@query("boosted_contributions_add_up", GAP_SQL)
def boosted_contributions_add_up(spark, sf):
    return _contribution_gaps(spark, sf, "gbm", lambda p: F.log(p / (F.lit(1.0) - p)))


@query("forest_contributions_add_up", GAP_SQL)
def forest_contributions_add_up(spark, sf):
    return _contribution_gaps(spark, sf, "rf", lambda p: p)


def _tree_importance(spark, sf, name: str) -> DataFrame:
    rows = stored(spark, L.prepared(feature_rows(spark, sf).where("by_match is not null"), FEATURES, "by_match", KEY))
    means = rows.agg(*[F.avg(c).alias(c) for c in FEATURES]).first().asDict()
    fitted = L.fit_one(name, rows, FEATURES, {k: v[0] for k, v in SHORT_GRIDS[name].items()})
    seen = rows if name in L.UNFILLED_MODELS else rows.fillna(means)
    return E.ranked(E.importance(T.tree_contributions(seen, KEY, FEATURES, L.as_trees(fitted.stages[-1]))))


@query("boosted_importance")
def boosted_importance(spark, sf):
    """Mean absolute exact contributions of a boosted model over all rows."""
    return _tree_importance(spark, sf, "gbm")


@query("forest_importance")
def forest_importance(spark, sf):
    return _tree_importance(spark, sf, "rf")


# ---- closed forms: one binary feature -------------------------------------------------------


def _binary(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_discount") > 0.05).cast("double").alias("a"), (F.col("l_quantity") > 40).cast("double").alias("b"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
    )
    return stored(spark, rows)


BINARY_SQL = """WITH d AS (SELECT (l_discount > 0.05)::INTEGER::DOUBLE AS a, (l_quantity > 40)::INTEGER::DOUBLE AS b,
  (l_returnflag = 'R')::INTEGER AS y FROM lineitem),
w AS (SELECT y, (SELECT count(*) FROM d) / (2.0::DOUBLE * count(*)) AS w FROM d GROUP BY y)"""
STUMP = {"n_estimators": 1, "max_depth": 1, "min_samples_leaf": 1, "max_features": 1.0, "class_weight": None, "ccp_alpha": 0.0}


def _one_tree(rows: DataFrame, feature: str):
    """A tree of one split on balanced rows: Spark joins leaves of one majority class, which both sides have otherwise."""
    forest = L.random_forest(STUMP, 0).setBootstrap(False)
    with L.prepared_vectors(rows, [feature], scale=False) as (prep, vectors):
        return L.PipelineModel([*prep.stages, forest.fit(L.with_class_weight(vectors, "balanced"))])


@query("tree_class_shares", BINARY_SQL + f"""
SELECT a, {q('sum(w) FILTER (y = 1) / sum(w)', 9)} AS score, count(*) AS n_rows FROM d JOIN w USING (y) GROUP BY a""")
def tree_class_shares(spark, sf):
    """A saved and loaded tree of one split scores a row by the weighted class share of its side."""
    rows, path = _binary(spark, sf), scratch(spark)
    L.save_model(_one_tree(rows, "a"), path)
    scored = L.positive_probability(L.load_model(path), rows)
    return scored.groupBy("a", quantise("score", 9).alias("score")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("soft_vote_class_shares", BINARY_SQL + f""",
sa AS (SELECT a, sum(w) FILTER (y = 1) / sum(w) AS p FROM d JOIN w USING (y) GROUP BY a),
sb AS (SELECT b, sum(w) FILTER (y = 1) / sum(w) AS p FROM d JOIN w USING (y) GROUP BY b)
SELECT a, b, {q('(sa.p + sb.p) / 2', 9)} AS score, count(*) AS n_rows FROM d JOIN sa USING (a) JOIN sb USING (b) GROUP BY a, b, sa.p, sb.p""")
def soft_vote_class_shares(spark, sf):
    """The vote of two trees of one split is the mean of two class shares."""
    rows = _binary(spark, sf)
    voted = L.soft_vote({f: _one_tree(rows, f) for f in ("a", "b")}, rows)
    return voted.groupBy("a", "b", quantise("score", 9).alias("score")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("logistic_log_odds", BINARY_SQL + f", g AS (SELECT a, ln(avg(y) / (1 - avg(y))) AS z FROM d GROUP BY a) SELECT a, {q('z', 3)} AS log_odds FROM g")
def logistic_log_odds(spark, sf):
    """Without a penalty, the fit on one binary feature has the log-odds of both groups."""
    rows = _binary(spark, sf)
    fitted = L.fit_one("lr", rows, ["a"], {"C": 1e12, "l1_ratio": 0.0})
    raw = vector_to_array("rawPrediction")[1]
    return fitted.transform(rows.select("a").distinct()).select("a", quantise(raw, 3).alias("log_odds"))
