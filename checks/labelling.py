"""Labels and the profiles built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    MATCH_LIMIT,
    OBJECTS_SQL,
    bin_sql,
    bridge,
    covered_objects,
    labelled_objects,
    match_source,
    orders_as_objects,
    populations,
    q,
    q_pct,
    query,
    scratch,
    shape_source,
    table,
)
from starloom.functions import as_column, log10_positive, quantise
from starloom.operators import labels, profile, quality
from starloom.operators.clean import coverage_join

WITH = f"WITH {OBJECTS_SQL}"


def c(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


LABEL_COUNTS_SQL = f"""{WITH}
SELECT population, count(*) AS n_objects, {c('by_match')} AS match_positive, {c('NOT by_match')} AS match_negative,
  {q_pct(c('by_match'), 'count(*)')} AS pct_match_positive, {c('by_relation')} AS relation_positive,
  {c('NOT by_relation')} AS relation_negative, {c('by_relation IS NULL')} AS relation_null,
  {c('agree')} AS labels_agree, {c('NOT agree')} AS labels_disagree, {c('agree IS NULL')} AS agreement_null
FROM lab GROUP BY population"""


@query("label_counts", LABEL_COUNTS_SQL)
def label_counts(spark, sf):
    return profile.label_counts(labelled_objects(spark, sf), ["population"], "by_match", "by_relation", "agree")


@query("label_counts_documents", f"""
WITH d AS (SELECT lang, quality IS NOT NULL AS has,
  CASE WHEN quality IS NULL THEN NULL WHEN n_chars >= 5000 THEN FALSE
       WHEN quality < 0.3::DOUBLE * log10(CASE WHEN n_chars > 0 THEN n_chars END) - 0.5::DOUBLE THEN TRUE ELSE FALSE END AS r,
  NOT coalesce(toxic = 1, FALSE) AS m FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT *, r = m AS a FROM d)
SELECT lang, count(*) AS n_objects, {c('m')} AS match_positive, {c('NOT m')} AS match_negative,
  {q_pct(c('m'), 'count(*)')} AS pct_match_positive, {c('r')} AS relation_positive, {c('NOT r')} AS relation_negative,
  {c('r IS NULL')} AS relation_null, {c('a')} AS labels_agree, {c('NOT a')} AS labels_disagree,
  {c('a IS NULL')} AS agreement_null FROM e GROUP BY lang""")
def label_counts_documents(spark, sf):
    docs = coverage_join(
        table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"], "quality", "has"
    )
    rows = docs.select(
        "lang",
        labels.relation_label(F.col("has"), F.col("quality"), F.col("n_chars"), 0.3, -0.5, 5000).alias("r"),
        labels.absence_label(F.col("toxic") == 1).alias("m"),
    ).withColumn("a", labels.agreement(F.col("r"), F.col("m")))
    return profile.label_counts(rows, ["lang"], "m", "r", "a")


@query("label_rows", f"""{WITH} SELECT object_id, population, by_relation, by_match, agree FROM lab""")
def label_rows(spark, sf):
    return labelled_objects(spark, sf).select("object_id", "population", "by_relation", "by_match", "agree")


@query("label_totals", f"""{WITH}
SELECT 'by_relation' AS label, {c('by_relation')} AS n_positive, {c('NOT by_relation')} AS n_negative,
  {c('by_relation IS NULL')} AS n_null FROM lab
UNION ALL SELECT 'by_match', {c('by_match')}, {c('NOT by_match')}, {c('by_match IS NULL')} FROM lab
UNION ALL SELECT 'agree', {c('agree')}, {c('NOT agree')}, {c('agree IS NULL')} FROM lab""")
def label_totals(spark, sf):
    return profile.label_totals(labelled_objects(spark, sf), ["by_relation", "by_match", "agree"])


@query("label_contingency", f"""{WITH}, n AS (SELECT by_relation, by_match, count(*) AS n FROM lab
  WHERE by_relation IS NOT NULL AND by_match IS NOT NULL GROUP BY ALL)
SELECT by_relation, by_match, n, {q('100.0::DOUBLE * n / (SELECT sum(n) FROM n)', 6)} AS percent FROM n""")
def label_contingency(spark, sf):
    out = profile.contingency(labelled_objects(spark, sf), "by_relation", "by_match")
    return out.withColumn("percent", quantise("percent", 6))


@query("label_agreement_breakdown", f"""{WITH}
SELECT population, {c('agree AND by_match')} AS agree_positive, {c('NOT agree')} AS disagree,
  {c('agree AND NOT by_match')} AS agree_negative, {c('agree IS NULL')} AS null_agreement
FROM lab GROUP BY population""")
def label_agreement_breakdown(spark, sf):
    return profile.agreement_breakdown(labelled_objects(spark, sf), ["population"], "by_match", "agree")


@query("null_rate_by_mass_floor", f"""{WITH}
SELECT population, floor(log10(mass))::BIGINT AS log_floor, {c('agree IS NULL')} AS n_null,
  {c('agree IS NOT NULL')} AS n_non_null, {q(c('agree IS NULL') + '::DOUBLE / count(*)', 6)} AS null_frac
FROM lab GROUP BY ALL""")
def null_rate_by_mass_floor(spark, sf):
    rows = labelled_objects(spark, sf).withColumn("log_mass", log10_positive("mass"))
    out = profile.null_rate_by_floor(rows, ["population"], "log_mass", "agree", "log_floor")
    return out.withColumn("null_frac", quantise("null_frac", 6))


@query("disagreement_rate_by_bin", f"""{WITH},
d AS (SELECT log10(rec_mass) AS v, NOT agree AS f FROM lab WHERE agree IS NOT NULL),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM d)
SELECT {bin_sql('v', 'lo', 'hi', 11)} AS bin, count(*) AS n, {q('avg(f::INTEGER::DOUBLE)', 6)} AS rate
FROM d, r WHERE v < hi GROUP BY 1""")
def disagreement_rate_by_bin(spark, sf):
    rows = labelled_objects(spark, sf).where(F.col("agree").isNotNull()).select(
        log10_positive("rec_mass").alias("v"), (~F.col("agree")).alias("f")
    )
    return profile.rate_per_bin(rows, "v", "f", 11).withColumn("rate", quantise("rate", 6))


@query("population_summary", f"""{WITH},
a AS (SELECT cov.population, cov.kind, lab.by_match FROM cov LEFT JOIN lab USING (object_id))
SELECT population, count(*) AS n_objects, {c("kind = 'F'")} AS n_f, {c("kind = 'O'")} AS n_o,
  {c('by_match')} AS n_positive, {c('NOT by_match')} AS n_negative,
  {q_pct(c('by_match'), "nullif(" + c("kind = 'F'") + ", 0)")} AS pct_positive
FROM a GROUP BY population""")
def population_summary(spark, sf):
    rows = orders_as_objects(spark, sf).join(
        labelled_objects(spark, sf).select("object_id", "by_match"), "object_id", "left"
    )
    return profile.population_summary(rows, ["population"], "by_match", "kind", {"F": "n_f", "O": "n_o"}, "F")


@query("conditional_means_by_label", f"""{WITH}
SELECT population, {c('by_match')} AS n_positive, {c('NOT by_match')} AS n_negative,
  {q_pct(c('by_match'), 'count(*)', 3)} AS pct_positive,
  {q('avg(shape) FILTER (WHERE by_match)', 3)} AS mean_positive,
  {q('avg(shape) FILTER (WHERE NOT by_match)', 3)} AS mean_negative FROM lab GROUP BY population""")
def conditional_means_by_label(spark, sf):
    return profile.conditional_means(labelled_objects(spark, sf), ["population"], "by_match", "shape")


@query("feature_shift_means", f"""{WITH}
SELECT population, {q('avg(log_mass)', 3)} AS mean_log_mass, {q('avg(mass)', 2)} AS mean_mass,
  {q('avg(shape)', 4)} AS mean_shape, count(*) AS n FROM (SELECT *, log10(mass) AS log_mass FROM lab) GROUP BY population""")
def feature_shift_means(spark, sf):
    rows = labelled_objects(spark, sf).withColumn("log_mass", log10_positive("mass"))
    return profile.mean_profile(rows, ["population"], {"log_mass": 3, "mass": 2, "shape": 4})


@query("mean_and_spread_by_label", f"""{WITH}
SELECT kind, by_match, count(*) AS n, {q('avg(mass)', 2)} AS mean_mass, {q('stddev_samp(mass)', 2)} AS std_mass,
  {q('avg(shape)', 3)} AS mean_shape, {q('stddev_samp(shape)', 3)} AS std_shape FROM lab GROUP BY kind, by_match""")
def mean_and_spread_by_label(spark, sf):
    return profile.mean_and_spread(labelled_objects(spark, sf), ["kind", "by_match"], {"mass": 2, "shape": 3})


@query("class_mean_lines", f"""{WITH} SELECT by_match, {q('avg(shape)', 6)} AS mean FROM lab WHERE shape IS NOT NULL GROUP BY 1""")
def class_mean_lines(spark, sf):
    from starloom.operators.distributions import class_mean_lines as lines

    return lines(labelled_objects(spark, sf), "shape", ["by_match"]).withColumn("mean", quantise("mean", 6))


@query("record_coverage", f"""{WITH}
SELECT population, count(*) AS n_total, {c('has_record')} AS n_with, {c('NOT has_record')} AS n_without,
  {q(c('has_record') + '::DOUBLE / count(*)', 6)} AS frac_covered FROM cov GROUP BY population""")
def record_coverage(spark, sf):
    out = profile.coverage(
        covered_objects(spark, sf), ["population"], "has_record", "n_total", "n_with", "n_without", "frac_covered"
    )
    return out.withColumn("frac_covered", quantise("frac_covered", 6))


@query("coverage_join_documents", """
SELECT doc_id, lang, quality, toxic, quality IS NOT NULL AS has_label
FROM documents LEFT JOIN labels USING (doc_id)""")
def coverage_join_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return coverage_join(docs, table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"], "quality", "has_label")


@query("observed_coverage", f"""
SELECT count(*) AS n_total, {c('quality IS NOT NULL')} AS n_hit,
  {q_pct(c('quality IS NOT NULL'), 'count(*)', 6)} AS pct_hit FROM documents LEFT JOIN labels USING (doc_id)""")
def observed_coverage(spark, sf):
    path = scratch(spark)
    coverage_join_documents(spark, sf).write.parquet(path)
    rate = quality.written_rate(spark, path, "quality")
    return rate.drop("n_miss").withColumn("pct_hit", quantise("pct_hit", 6))


@query("records_with_population", f"""{WITH}
SELECT rec.object_id, {q('rec.shape', 6)} AS shape, obj.kind FROM rec JOIN obj USING (object_id)""")
def records_with_population(spark, sf):
    records = shape_source(spark, sf).select("object_id", quantise("shape", 6).alias("shape"))
    return records.join(orders_as_objects(spark, sf).select("object_id", "kind"), "object_id")


BEST_SQL = """
WITH m AS (SELECT l_orderkey AS parent, l_suppkey AS candidate, l_quantity * l_quantity / 2500.0::DOUBLE AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, candidate) AS k FROM m WHERE score >= 0.6::DOUBLE),
b AS (SELECT parent, candidate AS best_candidate, score AS best_score, TRUE AS has_counterpart FROM r WHERE k = 1)
"""


@query("best_match", BEST_SQL + """
SELECT parent, best_candidate, best_score, has_counterpart FROM b
UNION ALL
SELECT DISTINCT parent, NULL::BIGINT, NULL::DOUBLE, FALSE FROM m WHERE parent NOT IN (SELECT parent FROM b)""")
def best_match(spark, sf):
    return labels.best_match(_candidates(spark, sf), ["parent"], "candidate", "score", MATCH_LIMIT)


@query("best_match_union", BEST_SQL + """
SELECT parent, best_candidate, best_score, has_counterpart FROM b
UNION ALL
SELECT DISTINCT parent, NULL::BIGINT, NULL::DOUBLE, FALSE FROM m WHERE parent NOT IN (SELECT parent FROM b)""")
def best_match_union(spark, sf):
    """The same result step by step: threshold, top one, anti join, typed NULLs, union by name."""
    rows = _candidates(spark, sf)
    top = labels.top_candidates(rows, ["parent"], "candidate", "score", MATCH_LIMIT)
    missing = labels.unmatched_parents(rows, top, ["parent"]).withColumns({
        "best_candidate": F.lit(None).cast("bigint"),
        "has_counterpart": F.lit(False),
    })
    found = top.withColumnsRenamed({"candidate": "best_candidate", "score": "best_score"})
    return found.withColumn("has_counterpart", F.lit(True)).unionByName(missing, allowMissingColumns=True)


def _candidates(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("parent"),
        F.col("l_suppkey").alias("candidate"),
        (F.col("l_quantity") * F.col("l_quantity") / 2500.0).alias("score"),
    )


@query("unmatched_parents", BEST_SQL + "SELECT DISTINCT parent FROM m WHERE parent NOT IN (SELECT parent FROM b)")
def unmatched_parents(spark, sf):
    rows = _candidates(spark, sf)
    top = labels.top_candidates(rows, ["parent"], "candidate", "score", MATCH_LIMIT)
    return labels.unmatched_parents(rows, top, ["parent"])


@query("candidates_above_threshold", """
SELECT l_orderkey AS parent, l_suppkey AS candidate, l_quantity * l_quantity / 2500.0::DOUBLE AS score
FROM lineitem WHERE l_quantity * l_quantity / 2500.0::DOUBLE >= 0.6::DOUBLE""")
def candidates_above_threshold(spark, sf):
    return _candidates(spark, sf).where(as_column("score") >= MATCH_LIMIT)


@query("match_statistics", f"""
WITH h AS (SELECT o_orderpriority AS pair, max(l_quantity * l_quantity / 2500.0::DOUBLE) >= 0.6::DOUBLE AS found
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority, l_orderkey)
SELECT pair, count(*) AS n_parents, {c('found')} AS n_matched, {c('NOT found')} AS n_unmatched,
  {q(c('found') + '::DOUBLE / count(*)', 6)} AS frac_matched FROM h GROUP BY pair""")
def match_statistics(spark, sf):
    best = labels.best_match(match_source(spark, sf), ["pair", "object_id"], "candidate", "score", MATCH_LIMIT, found="found")
    out = profile.coverage(best, ["pair"], "found", "n_parents", "n_matched", "n_unmatched", "frac_matched")
    return out.withColumn("frac_matched", quantise("frac_matched", 6))


@query("score_summary", f"""
SELECT o_orderpriority AS pair, count(*) AS n, min(s) AS score_min, {q('avg(s)', 6)} AS score_mean, max(s) AS score_max
FROM (SELECT o_orderpriority, l_quantity * l_quantity / 2500.0::DOUBLE AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
GROUP BY 1""")
def score_summary(spark, sf):
    out = profile.score_summary(match_source(spark, sf), ["pair"], "score", "score")
    return out.withColumn("score_mean", quantise("score_mean", 6))


@query("pair_bridge", """
SELECT o_orderpriority AS pair, o_orderpriority AS priority,
  max(CASE WHEN o_orderstatus = 'F' THEN o_orderstatus || ':' || o_orderpriority END) AS f_population,
  max(CASE WHEN o_orderstatus = 'O' THEN o_orderstatus || ':' || o_orderpriority END) AS o_population
FROM orders GROUP BY o_orderpriority""")
def pair_bridge(spark, sf):
    return bridge(spark, sf)


@query("population_counts", """
SELECT o_orderstatus || ':' || o_orderpriority AS population, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY ALL""")
def population_counts(spark, sf):
    objects = orders_as_objects(spark, sf).select("population")
    joined = objects.join(populations(spark, sf).select("population", "kind"), "population")
    return profile.group_count(joined, ["population", "kind"])
