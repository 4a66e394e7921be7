"""Joins, aggregates, reshaping, scalar functions, table rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import OBJECTS_SQL, bin_sql, labelled_objects, orders_as_objects, populations, q, q_pct, query, table
from starloom import functions as S
from starloom.operators import profile, quality
from starloom.operators.clean import below_limit, drop_present, enrich, host_flags, rename_present
from starloom.operators.metrics import is_correct, predicted_class
from starloom.operators.models import LABEL
from starloom.operators.ordered import forward_fill
from starloom.plans.training import assemble


def c(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


# ---- projections, filters, scalar functions -------------------------------------------------


@query("clean_columns", """
SELECT p_partkey AS object_id, p_name AS object_name, p_size AS n_particles, p_retailprice AS mass, p_size < 10 AS below_limit
FROM part""")
def clean_columns(spark, sf):
    kept = drop_present(table(spark, sf, "part"), ["p_brand", "p_type", "p_not_there"])
    named = rename_present(kept, {
        "p_partkey": "object_id", "p_name": "object_name", "p_size": "n_particles",
        "p_retailprice": "mass", "p_absent": "absent",
    })
    return named.withColumn("below_limit", below_limit(F.col("n_particles"), 10))


@query("host_flags", """
SELECT c_custkey, c_nationkey, c_nationkey = 0 AS is_host, c_nationkey <> 0 AS is_subhalo FROM customer""")
def host_flag_columns(spark, sf):
    return host_flags(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


@query("flag_counts_by_group", f"""
SELECT c_mktsegment, count(*) AS n, {c('c_nationkey = 0')} AS n_hosts, {c('c_nationkey <> 0')} AS n_subs,
  {c('c_acctbal < 100')} AS n_below FROM customer GROUP BY c_mktsegment""")
def flag_counts_by_group(spark, sf):
    return profile.conditional_counts(table(spark, sf, "customer"), ["c_mktsegment"], {
        "n_hosts": F.col("c_nationkey") == 0,
        "n_subs": F.col("c_nationkey") != 0,
        "n_below": below_limit(F.col("c_acctbal"), 100),
    })


@query("log_and_box_features", f"""
SELECT c_custkey, {q('CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END', 6)} AS log_balance,
  {q('c_acctbal / (25.0::DOUBLE * 1000.0::DOUBLE)', 6)} AS x_norm, {q('c_acctbal / 1000.0::DOUBLE', 6)} AS x_mpc,
  c_acctbal IS NULL AS missing FROM customer""")
def log_and_box_features(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        S.quantise(S.log10_positive("c_acctbal"), 6).alias("log_balance"),
        S.quantise(S.box_fraction("c_acctbal", F.lit(25.0)), 6).alias("x_norm"),
        S.quantise(F.col("c_acctbal") / 1000.0, 6).alias("x_mpc"),
        F.col("c_acctbal").isNull().alias("missing"),
    )


@query("composite_text_fields", f"""
WITH t AS (SELECT o_orderkey, 'snap_0' || substr(o_orderpriority, 1, 1) || '-z' || (o_orderkey % 40)::VARCHAR || '.5' AS txt,
  'z' || substr(o_orderpriority, 1, 1) || '_' || CASE WHEN o_orderstatus = 'F' THEN 'fixed' ELSE 'adapt' END AS setup,
  o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderkey, substr(o_orderpriority, 1, 1)::BIGINT AS snap,
  {q('1.0::DOUBLE / (1.0::DOUBLE + (o_orderkey % 40) + 0.5::DOUBLE)', 8)} AS a,
  substr(o_orderpriority, 1, 1)::INTEGER AS z_ini,
  CASE WHEN o_orderstatus = 'F' THEN 'fixed' ELSE 'adaptive' END AS softening FROM t""")
def composite_text_fields(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("snap_0"), first, F.lit("-z"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".5")).alias("txt"),
        F.concat(F.lit("z"), first, F.lit("_"),
                 F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("adapt")).alias("setup"),
    )
    return rows.select(
        "o_orderkey",
        S.snapshot_number("txt").alias("snap"),
        S.quantise(S.scale_factor("txt"), 8).alias("a"),
        S.setup_redshift("setup").alias("z_ini"),
        S.setup_softening("setup").alias("softening"),
    )


@query("recomputed_merit", f"""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
  {q('l_quantity * l_quantity / (l_linenumber * (l_tax * 100.0::DOUBLE + 1.0::DOUBLE))', 6)} AS merit,
  {q('0.0624::DOUBLE * log10(l_extendedprice) + -0.0988::DOUBLE', 6)} AS relation FROM lineitem""")
def recomputed_merit(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        S.quantise(S.merit("l_quantity", "l_linenumber", F.col("l_tax") * 100.0 + 1.0), 6).alias("merit"),
        S.quantise(S.linear_relation("l_extendedprice", 0.0624, -0.0988), 6).alias("relation"),
    )


@query("member_and_range_filter", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10 AND l_quantity < 20 AND l_shipdate IS NOT NULL""")
def member_and_range_filter(spark, sf):
    return spark.sql(
        "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity FROM {li} "
        "WHERE array_contains(:flags, l_returnflag) AND l_quantity >= :lo AND l_quantity < :hi AND l_shipdate IS NOT NULL",
        args={"flags": F.array(F.lit("A"), F.lit("R")), "lo": 10, "hi": 20},
        li=table(spark, sf, "lineitem"),
    )


@query("constant_and_typed_null_columns", """
SELECT n_nationkey, n_name, 'nation' AS source, NULL::BIGINT AS best_id, NULL::DOUBLE AS best_score FROM nation""")
def constant_and_typed_null_columns(spark, sf):
    return table(spark, sf, "nation").select(
        "n_nationkey", "n_name", F.lit("nation").alias("source"),
        F.lit(None).cast("bigint").alias("best_id"), F.lit(None).cast("double").alias("best_score"),
    )


# ---- joins ----------------------------------------------------------------------------------


@query("dimension_enrichment", """
SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_enrichment(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    joined = enrich(enrich(rows, nation, "c_nationkey", ["n_name", "n_regionkey"]), region, "n_regionkey", ["r_name"])
    return joined.select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("counts_by_dimension", """
SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def counts_by_dimension(spark, sf):
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return profile.group_count(joined, ["r_name", "n_name"])


@query("top_objects", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 5""")
def top_objects(spark, sf):
    return profile.preview(
        table(spark, sf, "orders"), ["o_orderkey", "o_orderpriority", "o_totalprice"], 5,
        [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")],
    )


@query("mixed_order", """
SELECT n_name, r_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name, n_name DESC""")
def mixed_order(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select("n_name", "r_name", "n_regionkey").orderBy(F.asc("r_name"), F.desc("n_name"))


@query("distinct_parents", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct_parents(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@query("value_bounds", """
SELECT l_returnflag, min(l_quantity) AS qty_min, max(l_quantity) AS qty_max, min(l_extendedprice) AS price_min,
  max(l_extendedprice) AS price_max, min(l_discount) AS disc_min, max(l_discount) AS disc_max,
  min(l_tax) AS tax_min, max(l_tax) AS tax_max FROM lineitem GROUP BY l_returnflag""")
def value_bounds(spark, sf):
    return profile.value_bounds(table(spark, sf, "lineitem"), ["l_returnflag"], {
        "l_quantity": "qty", "l_extendedprice": "price", "l_discount": "disc", "l_tax": "tax",
    })


# ---- profiles -------------------------------------------------------------------------------

DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@query("null_profile", "\nUNION ALL\n".join(
    f"SELECT '{col}' AS feature, count(*) AS n_total, {c(col + ' IS NULL')} AS n_null, "
    f"{q(c(col + ' IS NULL') + '::DOUBLE / count(*)', 6)} AS null_frac FROM documents LEFT JOIN labels USING (doc_id)"
    for col in DOC_COLUMNS))
def null_profile(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    out = profile.null_profile(rows, DOC_COLUMNS)
    return out.withColumn("null_frac", S.quantise("null_frac", 6))


@query("union_all_counts", """
SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events""")
def union_all_counts(spark, sf):
    parts = [
        table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("source"), "n")
        for t in ("orders", "lineitem", "events")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("table_row_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations")))
def table_row_counts(spark, sf):
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
             "labels conversations").split()
    return quality.row_counts({t: table(spark, sf, t) for t in names})


@query("column_means", f"""
SELECT {q('avg(quality)', 6)} AS quality, {q('avg(toxic)', 6)} AS toxic, {q('avg(n_chars)', 4)} AS n_chars
FROM documents LEFT JOIN labels USING (doc_id)""")
def column_means(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    means = profile.column_means(rows, ["quality", "toxic", "n_chars"])
    return means.select(
        S.quantise("quality", 6).alias("quality"), S.quantise("toxic", 6).alias("toxic"),
        S.quantise("n_chars", 4).alias("n_chars"),
    )


@query("class_weights", f"""
SELECT {c('toxic = 1')} AS n_positive, {c('toxic <> 1')} AS n_negative,
  {q(c('toxic <> 1') + '::DOUBLE / ' + c('toxic = 1'), 6)} AS pos_weight,
  {q('count(*)::DOUBLE / (2 * ' + c('toxic = 1') + ')', 6)} AS weight_positive,
  {q('count(*)::DOUBLE / (2 * ' + c('toxic <> 1') + ')', 6)} AS weight_negative FROM labels""")
def class_weights(spark, sf):
    out = profile.class_weights(table(spark, sf, "labels"), "toxic")
    return out.withColumns({n: S.quantise(n, 6) for n in ("pos_weight", "weight_positive", "weight_negative")})


@query("misclassified_by_group", f"""
WITH p AS (SELECT event_type, (value >= 50)::INTEGER AS pred, (user_id < 75)::INTEGER AS y FROM events)
SELECT event_type, count(*) AS n_total, {c('pred <> y')} AS n_wrong, {q_pct(c('pred <> y'), 'count(*)')} AS pct_wrong
FROM p GROUP BY event_type""")
def misclassified_by_group(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_type", predicted_class("value", 50.0).alias("pred"), (F.col("user_id") < 75).cast("int").alias("y")
    )
    return profile.misclassified(rows, ["event_type"], "y", "pred")


@query("prediction_rows", """
SELECT event_id, (value >= 50)::INTEGER AS pred, ((value >= 50)::INTEGER = (event_type = 'purchase')::INTEGER)::INTEGER AS correct
FROM events""")
def prediction_rows(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", predicted_class("value", 50.0).alias("pred"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
    )
    return rows.select("event_id", "pred", is_correct("y", "pred").alias("correct"))


@query("binned_error_rates", f"""
WITH p AS (SELECT l_extendedprice AS v, (l_returnflag = 'R')::INTEGER AS y, (l_quantity >= 25)::INTEGER AS pred FROM lineitem),
b AS (SELECT {bin_sql('v', '1000.0::DOUBLE', '90000.0::DOUBLE', 15)} AS bin, y, pred
  FROM p WHERE v >= 1000 AND v < 90000)
SELECT bin, count(*) AS n,
  CASE WHEN count(*) >= 5 THEN {q('avg((pred = 0)::INTEGER::DOUBLE) FILTER (WHERE y = 1)', 6)} END AS fn_rate,
  CASE WHEN count(*) >= 5 THEN {q('avg((pred = 1)::INTEGER::DOUBLE) FILTER (WHERE y = 0)', 6)} END AS fp_rate
FROM b GROUP BY bin""")
def binned_error_rates(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("v"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        predicted_class("l_quantity", 25.0).alias("pred"),
    )
    out = profile.binned_error_rates(rows, "v", "y", "pred", 1000.0, 90000.0, 15)
    return out.withColumns({n: S.quantise(n, 6) for n in ("fn_rate", "fp_rate")})


# ---- reshaping ------------------------------------------------------------------------------


@query("wide_to_long", """
SELECT l_returnflag, feature, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM (
  SELECT l_returnflag, 'l_quantity' AS feature, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY ALL""")
def wide_to_long(spark, sf):
    tall = profile.wide_to_long(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    return tall.groupBy("l_returnflag", "feature").agg(
        F.count("value").alias("n"), S.quantise(F.sum("value"), 2).alias("total")
    )


@query("pivot_by_status", """
SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS O,
  max(CASE WHEN o_orderstatus = 'P' THEN n END) AS P
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def pivot_by_status(spark, sf):
    counts = profile.group_count(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])
    return profile.pivot_metric(counts, "o_orderpriority", "o_orderstatus", "n", ["F", "O", "P"])


@query("diagonal_union", """
SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def diagonal_union(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")
    )
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    return customer.unionByName(supplier, allowMissingColumns=True)


# ---- forward fill ---------------------------------------------------------------------------


@query("forward_fill_turns", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS user_turn,
  last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS user_length
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def forward_fill_turns(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"), F.floor(F.col("turn") / 4).alias("piece")
    )
    filled = forward_fill(
        rows, {"user_turn": F.col("turn"), "user_length": F.col("n")}, F.col("role") == "user",
        ["conv_id"], ["turn"], ["piece"],
    )
    return filled.select("conv_id", "turn", "role", "user_turn", "user_length")


# ---- table rules ----------------------------------------------------------------------------


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("rule_violations", """
SELECT * FROM (
  SELECT 'line key is unique' AS rule, count(*) AS n_violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'order key is unique', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
  UNION ALL SELECT 'flag is A or R', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) FROM lineitem
  UNION ALL SELECT 'quantity in 1..50', count(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 50) FROM lineitem
  UNION ALL SELECT 'discount below 0.05', count(*) FILTER (WHERE NOT l_discount < 0.05) FROM lineitem
  UNION ALL SELECT 'document has a label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
) WHERE n_violations > 0""")
def rule_violations(spark, sf):
    lines = table(spark, sf, "lineitem")
    return quality.violations(
        quality.rule_unique(lines, ["l_orderkey", "l_linenumber"], "line key is unique"),
        quality.rule_unique(table(spark, sf, "orders"), ["o_orderkey"], "order key is unique"),
        quality.rule_holds(lines, {
            "flag is A or R": F.col("l_returnflag").isin("A", "R"),
            "quantity in 1..50": F.col("l_quantity").between(1, 50),
            "discount below 0.05": F.col("l_discount") < 0.05,
        }),
        quality.rule_references(
            table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), "doc_id", "document has a label"
        ),
    )


# ---- training-set joins ---------------------------------------------------------------------

ROLE_SQL = """role AS (SELECT o_orderkey AS object_id,
  CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'test' END AS split_role FROM orders)"""


def roles_by_date(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("object_id"),
        F.when(F.col("o_orderdate") < "1996-01-01", "train").otherwise("test").alias("split_role"),
    )


@query("training_rows", f"""WITH {OBJECTS_SQL}, {ROLE_SQL}
SELECT object_id, {q('lab.mass', 2)} AS mass, by_match, split_role, c_mktsegment = 'BUILDING' AS flag
FROM lab JOIN role USING (object_id) JOIN orders ON object_id = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def training_rows(spark, sf):
    labelled = labelled_objects(spark, sf)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"), "o_custkey")
    flags = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").alias("flag")
    )
    rows = assemble(
        labelled.select("object_id", "mass"), labelled.select("object_id", "by_match"),
        roles_by_date(spark, sf).withColumn("split_name", F.lit("by_date")), "by_date",
        key=["object_id"], label="by_match", columns=["mass"], extra=orders.join(flags, "o_custkey").drop("o_custkey"),
    )
    return rows.select(
        "object_id", S.quantise("mass", 2).alias("mass"), (F.col(LABEL) == 1).alias("by_match"), "split_role", "flag"
    )


@query("split_balance", f"""WITH {OBJECTS_SQL}, {ROLE_SQL}
SELECT split_role, population, count(*) AS n_objects, {c('by_match')} AS n_positive, {c('NOT by_match')} AS n_negative,
  {q_pct(c('by_match'), 'count(*)')} AS pct_positive
FROM role JOIN obj USING (object_id) JOIN (SELECT object_id, by_match FROM lab) USING (object_id) GROUP BY split_role, population""")
def split_balance(spark, sf):
    joined = (
        roles_by_date(spark, sf)
        .join(orders_as_objects(spark, sf).select("object_id", "population"), "object_id")
        .join(labelled_objects(spark, sf).select("object_id", "by_match"), "object_id")
    )
    return profile.class_balance(joined, ["split_role", "population"], "by_match")


@query("train_column_means", f"""WITH {OBJECTS_SQL}, {ROLE_SQL}
SELECT {q('avg(mass)', 2)} AS mass, {q('avg(shape)', 6)} AS shape FROM lab JOIN role USING (object_id) WHERE split_role = 'train'""")
def train_column_means(spark, sf):
    rows = labelled_objects(spark, sf).join(roles_by_date(spark, sf), "object_id").where(F.col("split_role") == "train")
    means = profile.column_means(rows, ["mass", "shape"])
    return means.select(S.quantise("mass", 2).alias("mass"), S.quantise("shape", 6).alias("shape"))


@query("population_dimension", """
SELECT DISTINCT o_orderstatus || ':' || o_orderpriority AS population, o_orderstatus AS kind, o_orderpriority AS priority FROM orders""")
def population_dimension(spark, sf):
    return populations(spark, sf)
