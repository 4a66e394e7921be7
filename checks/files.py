"""Text and table sources: given tables are written in the source's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import q, query, scratch, table
from starloom.functions import quantise
from starloom.sources.shapes import shape_records
from starloom.sources.tables import create_layers, replace_table
from starloom.sources.text import plain_path, read_catalogue, read_matches


def _files(spark, folder: str) -> list[str]:
    """Paths of the written part files."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return [r["p"] for r in names.select(plain_path(F.col("path")).alias("p")).collect()]


@query("catalogue_text_scan", """
SELECT o_orderstatus AS simulation_id, o_orderkey AS halo_id, o_custkey AS npart, o_totalprice AS Mhalo FROM orders""")
def catalogue_text_scan(spark, sf):
    folder = f"{scratch(spark)}/with blank 100%41"
    orders = table(spark, sf, "orders")
    rows = orders.select(
        "o_orderstatus",
        F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("piece"),
        F.lit(1).alias("level"),
        F.concat(
            F.concat_ws("\t", "o_orderkey", F.concat(F.lit(" "), F.col("o_custkey").cast("string")), "o_totalprice"),
            F.lit("\t"),
        ).alias("value"),
    )
    # Every file starts with the header line, as each piece of a status has one.
    headers = rows.select(
        "o_orderstatus", "piece", F.lit(0).alias("level"), F.lit("#ID(1)\tnpart(2)\tMhalo(3)\t").alias("value")
    ).distinct()
    placed = rows.unionByName(headers).repartition("o_orderstatus", "piece")
    lines = placed.sortWithinPartitions("o_orderstatus", "piece", "level")
    lines.select("o_orderstatus", "value").write.partitionBy("o_orderstatus").text(folder)
    owned = {f"{p.split('o_orderstatus=')[1][0]}#{i}": p for i, p in enumerate(_files(spark, folder))}
    out = read_catalogue(spark, owned)
    return out.withColumn("simulation_id", F.substring_index("simulation_id", "#", 1))


@query("two_level_text_scan", """
SELECT l_orderkey AS wdm_halo_id, n AS wdm_npart, l_suppkey AS cdm_halo_id, l_partkey AS cdm_npart, l_linenumber::BIGINT AS n_shared,
  l_quantity AS merit FROM lineitem JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (l_orderkey)""")
def two_level_text_scan(spark, sf):
    folder = f"{scratch(spark)}/with blank 100%41"
    lines = table(spark, sf, "lineitem")
    parents = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).select(
        "l_orderkey", F.lit(0).alias("level"), F.concat_ws("  ", "l_orderkey", "n", "n").alias("value")
    )
    children = lines.select(
        "l_orderkey", F.lit(1).alias("level"),
        F.concat(F.lit("  "), F.concat_ws(" ", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")).alias("value"),
    )
    ordered = parents.unionByName(children).repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "level")
    ordered.select("value").write.text(folder)
    owned = {f"pair{i}": p for i, p in enumerate(_files(spark, folder))}
    return read_matches(spark, owned).drop("simulation_pair_id")


@query("shape_records", f"""
SELECT 'sim' AS simulation_id, l_orderkey AS halo_id, l_discount AS sphericity_s, l_linenumber::BIGINT AS snap_hmm,
  {q('1.0::DOUBLE / (1.0::DOUBLE + l_tax)', 8)} AS a_hmm, l_extendedprice AS m_hmm FROM lineitem""")
def shape_record_rows(spark, sf):
    folder = scratch(spark)
    table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("halo_id"),
        F.col("l_discount").alias("sphericity_halfmaxmass"),
        F.concat(F.lit("snap_"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit("-z"), F.col("l_tax").cast("string")).alias("halfmaxmass"),
        F.col("l_extendedprice").alias("mhalo_halfmaxmass"),
        F.col("l_shipdate").cast("string").alias("wide_column"),
    ).write.parquet(folder)
    return shape_records(spark.read.parquet(folder), "sim").withColumn("a_hmm", quantise("a_hmm", 8))


@query("replaced_table", """
SELECT c_custkey, c_mktsegment, c_acctbal + 2 AS c_acctbal FROM customer""")
def replaced_table(spark, sf):
    """A table written from a source, then twice replaced by a plan that reads it."""
    create_layers(spark, ["starloom_check"], scratch(spark))
    name = "starloom_check.customer_balance"
    out = replace_table(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), name)
    for _ in range(2):
        out = replace_table(out.withColumn("c_acctbal", F.col("c_acctbal") + 1), name)
    return out
