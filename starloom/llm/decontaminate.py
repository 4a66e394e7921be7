"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A long document has minima that say nothing about a short test item, so the minima of the item are looked
up in the document: a coordinate matches if the item's shingle with the least hash is one of the document's.
It does so with the probability of the containment, at any length of the document. Documents fall into
partitions by the power of two of their size, and an item is searched only in partitions whose largest
document could hold enough of it: its minima meet the documents by equal (partition, hash). Only the pairs found this
way are verified, by their exact count of shared shingles. One pass over the texts yields all hashes that either
step needs; texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.batches import SHINGLE_WORDS, mix, sliced, store, text_shingles

CONTAINMENT = 0.8
COORDINATES = 24
#: A pair is verified if this share of the item's distinct minima is found; at the least containment of 0.8
#: fewer than a quarter of 24 are found with a probability of about 1e-10.
FOUND_SHARE = 0.25
#: Bits of the two filters that items leave for the pass over the documents: at most 8 MB each at any number
#: of items. More items raise the share of shingles that pass a filter, not its size.
FILTER_BITS = 26
#: Partition of documents that have several rows: their size is that of all rows and is not known in a pass.
ANY_SIZE = 63


def item_shingles(items: DataFrame, id_col: str, text_col: str, coordinates: int, size: int) -> DataFrame:
    """Distinct shingles of every item, over all its rows: item_id, h, probe (a minimum of some coordinate of some row),
    n, n_probes."""
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            h, row = text_shingles(part.column(1), size)
            for r in np.unique(row):
                own = np.unique(h[row == r])
                probe = np.zeros(len(own), bool)
                for s in seeds:
                    probe[np.argmin(mix(own ^ s))] = True
                ids = pa.array([part.column(0)[int(r)].as_py()] * len(own), part.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.view(np.int64)), pa.array(probe)], ["item_id", "h", "probe"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(explode, f"item_id {kind}, h long, probe boolean")
    own = Window.partitionBy("item_id")
    return found.groupBy("item_id", "h").agg(F.max("probe").alias("probe")).withColumns({
        "n": F.count("*").over(own), "n_probes": F.sum(F.col("probe").cast("long")).over(own),
    })


def bit_filter(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bits of the shingles' hashes; what is fetched has at most one row for each 64 bits of the filter."""
    slot = F.pmod(F.col("h"), F.lit(1 << bits))
    words = shingles.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {1 << bits}) & 63 as int))")).alias("b")
    )
    got = words.toArrow()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return held


def passes(held: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = h & np.uint64((1 << bits) - 1)
    return (held[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, coordinates: int = COORDINATES,
    size: int = SHINGLE_WORDS, bits: int = FILTER_BITS, doc_id: str = "doc_id", item_id: str = "item_id",
    text_col: str = "text", item_text: str = "text",
) -> DataFrame:
    """Pairs of a document and an item with at least ``threshold`` of the item's distinct shingles in it.

    Returns doc_id, item_id, shared, item_shingles, containment. Items of fewer than ``size`` words and null
    or empty texts have no shingles and are in no pair. Rows of one id, null ids too, count as one document with the
    shingles of all its rows. Repeated items of one id likewise. Texts are read whole. Other columns are not read;
    empty tables give an empty one.
    """
    spark = docs.sparkSession
    shingles = store(item_shingles(items, item_id, item_text, coordinates, size), "item_shingles")
    filters = spark.sparkContext.broadcast((bit_filter(shingles.where("probe"), bits), bit_filter(shingles, bits)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, every = filters.value
        for part in sliced(batches):
            h, row = text_shingles(part.column(1), size)
            alone = ~part.column(2).to_numpy(zero_copy_only=False)
            sizes = np.bincount(row, minlength=part.num_rows)
            span = np.where(alone, np.log2(np.maximum(sizes, 1)).astype(np.int32), ANY_SIZE).astype(np.int32)
            probe = passes(probes, h, bits)
            found = ~alone  # what one row lacks, another one of its id may have
            found[row[probe]] = True
            near = found[row] & passes(every, h, bits)
            pairs, first = np.unique(np.stack([row[near].astype(np.uint64), h[near]]), axis=1, return_index=True)
            row, h, probe = pairs[0].astype(np.int64), pairs[1], probe[near][first]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(span[row]), pa.array(probe)],
                ["doc_id", "h", "part", "probe"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # as a table of known size: usually no id is repeated, and few ids need no shuffle of the texts
    several = store(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("several")), "repeated")
    marked = rows.join(several.withColumn("again", F.lit(True)), rows["doc_id"].eqNullSafe(several["several"]), "left")
    flagged = marked.select("doc_id", "text", F.coalesce("again", F.lit(False)).alias("again"))
    if several.isEmpty():
        flagged = rows.withColumn("again", F.lit(False))
    hits = flagged.mapInArrow(search, f"doc_id {kind}, h long, part int, probe boolean").dropDuplicates(["doc_id", "h"])
    hits = store(hits, "item_hits")
    there = sorted(r[0] for r in hits.select("part").distinct().collect())  # at most 64
    # a partition's largest document has 2 ** (part + 1) - 1 shingles
    reach = F.filter(F.array(*[F.lit(p) for p in there]), lambda p: F.pow(F.lit(2.0), p + 1) > threshold * F.col("n"))
    minima = shingles.where("probe").select("item_id", "h", "n_probes", F.explode(reach).alias("part"))
    candidates = (
        hits.where("probe").join(minima, ["part", "h"])
        .groupBy("doc_id", "item_id", "n_probes").agg(F.count("*").alias("probes"))
        .where(F.col("probes") >= F.ceil(FOUND_SHARE * F.col("n_probes")))
    )
    candidates = store(candidates.select(F.col("doc_id").alias("__doc"), "item_id"), "candidates")
    counted = (
        hits.join(candidates, hits["doc_id"].eqNullSafe(candidates["__doc"])).select("doc_id", "item_id", "h")
        .join(shingles.select("item_id", "h", "n"), ["item_id", "h"])
        .groupBy("doc_id", "item_id", F.col("n").alias("item_shingles")).agg(F.count("*").alias("shared"))
    )
    exact = F.col("shared") / F.col("item_shingles")
    return counted.where(exact >= threshold).select("doc_id", "item_id", "shared", "item_shingles", exact.alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain an item.

    Rows of one id go or stay together; a row without an id is judged by its own text.
    """
    named, text = F.col(options.pop("doc_id", "doc_id")), F.col(options.get("text_col", "text")).cast("string")
    own = F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    key = F.coalesce(F.concat(F.lit("id "), named.cast("string")), own)
    searched = docs.select(key.alias("__key"), text.alias("__text"))
    options["text_col"] = "__text"
    hit = contained_items(searched, items, doc_id="__key", **options).select(F.col("doc_id").alias("__hit")).distinct()
    hit = store(hit, "contaminated")  # as a table of known size: a short list needs no shuffle of the texts
    return docs.join(hit, key == hit["__hit"], "left_anti")
