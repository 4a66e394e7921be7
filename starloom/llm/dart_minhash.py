"""Near duplicates by DartMinHash signatures, banded joins and an exact check.

The shingles of a text are elements weighted by their number. A dart is thrown into the region (shingle,
unit of weight) x time by a hash of the region: the times of its darts are a Poisson process, the same in
every text. A text sees the darts of its own regions up to a time at which about k ln k + 2 k of them have
come, each dart belongs to one of k coordinates by its hash, and a coordinate keeps its earliest dart. Two
texts keep the same dart with the probability of their weighted Jaccard similarity. Work is in proportion
to the shingles plus k ln k, not to their product with k.

Signatures are cut into bands; texts that agree in a band are candidates. Exact copies are one node from
the start. In each bucket the member with the largest buckets is the centre, and all buckets of one centre
become one star: any two candidates meet in some star, and a text comes to few of them, however many bands
it shares. Stars of more than ``BLOCK_NODES`` texts or ``BLOCK_SHINGLES`` shingles are dealt as pairs of
hashed blocks, so a task holds two blocks at most and nothing is cut off. A task counts the shared shingles
of all its texts by matrix products, which gives the exact similarity, and returns a spanning forest of the
links instead of all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.batches import SHINGLE_WORDS, mix, partitions, sliced, store, text_shingles
from starloom.llm.components import components
from starloom.llm.decontaminate import FILTER_BITS, bit_filter, passes

SIMILARITY = 0.8
#: A pair of similarity 0.8 agrees in none of 36 bands of 6 with a probability of 2e-5; one of 0.3, in any
#: with one of 0.03.
BANDS, BAND_ROWS = 36, 6
#: Largest part of a star in one task, twice over.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000


def occurrences(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of each (shingle, how often it came before in its row): a multiset as a set."""
    key = mix(h ^ mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    unit = np.empty(len(key), np.uint64)
    unit[order] = (np.arange(len(key)) - start).astype(np.uint64)
    return np.where(unit > 0, mix(h + mix(unit)), h)


def dart_signatures(
    element: np.ndarray, row: np.ndarray, n_rows: int, k: int, share: np.ndarray | None = None
) -> np.ndarray:
    """Signature of each row of unit-weight regions ``element``: the times of its earliest darts.

    ``share`` (0 to 1) is the part of a region that belongs to the row, for weights that are no whole
    numbers: a dart counts if it hits that part. Rows without a region have infinite times.
    """
    total = np.bincount(row, weights=share, minlength=n_rows)
    best = np.full(n_rows * k, np.inf)
    open_ = total > 0
    horizon = np.where(open_, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    while open_.any():
        at = np.flatnonzero(open_[row])
        hashed, mine, time, turn = element[at], row[at], np.zeros(len(at)), 0
        part = None if share is None else share[at]
        while len(at):
            turn += 1
            dart = mix(hashed + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            at = np.flatnonzero(time < horizon[mine])
            hashed, mine, time, dart = hashed[at], mine[at], time[at], dart[at]
            spot = mine * k + (mix(dart ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(k)).astype(np.int64)
            if part is None:
                np.minimum.at(best, spot, time)
            else:
                part = part[at]
                inside = (mix(dart + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part
                np.minimum.at(best, spot[inside], time[inside])
        open_ &= np.isinf(best.reshape(n_rows, k)).any(1)
        horizon = np.where(open_, 2 * horizon, horizon)
    return best.reshape(n_rows, k)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2])
    for j in range(bits.shape[2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, j])
    return key


def sketches(docs: DataFrame, bands: int, rows: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (md5 of the text) and one key for each band; none for texts without a shingle."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            h, row = text_shingles(part.column(1), size)
            n = part.num_rows
            keys = band_keys(dart_signatures(occurrences(h, row), row, n, bands * rows), bands)
            has = np.bincount(row, minlength=n) > 0
            at = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[has].ravel().view(np.int64)))
            fp = [hashlib.md5(t.as_buffer() if t.is_valid else b"").digest() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.binary()), lists], ["doc_id", "fp", "keys"])

    rows_in = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(sketch, f"doc_id {kind}, fp binary, keys array<long>")


def fingerprint(text_col: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """One text of each node. A filter of 8 MB at most lets only its share of the texts reach the join."""


    low = F.conv(F.substring(F.hex("fp"), 1, 8), 16, 10).cast("long")
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes.select(low.alias("h")), FILTER_BITS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 0):
            fp = [hashlib.md5(t.as_buffer() if t.is_valid else b"").digest() for t in part.column(0)]
            h = np.array([int.from_bytes(x[:4], "big") for x in fp], np.uint64)
            passed = np.flatnonzero(passes(held.value, h, FILTER_BITS))
            yield pa.RecordBatch.from_arrays(
                [pa.array([fp[i] for i in passed], pa.binary()), part.column(0).take(pa.array(passed))], ["fp", "text"]
            )

    picked = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(pick, "fp binary, text string")
    # copies are collapsed before the shuffle, so a text with many copies is one row of each task
    return picked.groupBy("fp").agg(F.first("text").alias("text")).join(nodes, "fp", "left_semi")


def spanning_links(h: np.ndarray, row: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """For each of ``n`` sets of hashes the least set that a chain of links joins to it."""
    size = np.bincount(row, minlength=n)
    value, column, times = np.unique(h, return_inverse=True, return_counts=True)
    held = times[column] > 1
    row, column = row[held], (np.cumsum(times > 1) - 1)[column[held]]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, (1 << 22) // max(n, 1))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(column, [low, low + width]))
        dense = np.zeros((n, width), np.float32)
        dense[row[at], column[at] - low] = 1
        shared += dense @ dense.T
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-3
    linked &= shared > 0
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def star_links(members: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (a, b) inside each unit; ``members`` has unit, fp and text, ordered by unit in each partition."""

    def forest(fps: list, parts: list) -> pa.RecordBatch:
        sizes = [len(p) for p in parts]
        label = spanning_links(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), len(parts), threshold)
        at = np.flatnonzero(label != np.arange(len(parts))).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([fps[i] for i in at], pa.binary()), pa.array([fps[label[i]] for i in at], pa.binary())], ["a", "b"]
        )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, fps, parts = None, [], []
        for part in sliced(batches, 2):
            h, row = text_shingles(part.column(2), size)
            h = occurrences(h, row)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i, (u, fp) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if u != unit:
                    if len(fps) > 1:
                        yield forest(fps, parts)
                    unit, fps, parts = u, [], []
                fps.append(fp)
                parts.append(h[at[i] : at[i + 1]])
        if len(fps) > 1:
            yield forest(fps, parts)

    return members.select("unit", "fp", "text").mapInArrow(link, "a binary, b binary")


def near_duplicate_classes(
    docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS,
    size: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, class_fp (names the class), class_id, class_size.

    Rows are in one class if a chain of links joins them; ``class_id`` is the least id of the class, null if
    all of them are null. Equal texts are linked, null texts count as empty ones; texts of fewer than
    ``size`` words have no shingle and are linked to equal texts only. Other columns are not read.
    """
    sketch = store(sketches(docs, bands, rows, size, id_col, text_col), "sketch")
    nodes = sketch.groupBy("fp").agg(F.first("keys").alias("keys"))
    banded = nodes.select("fp", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = store(banded.join(shared, "key"), "members")
    labels = components(_links(docs, members, threshold, size, text_col))

    own = sketch.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    own = own.join(labels, own["fp"] == labels["node"], "left").select(
        "fp", "least", "copies", F.coalesce("label", "fp").alias("label")
    )
    own = store(own, "nodes")
    classes = own.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    classed = own.join(classes, "label").select("fp", F.col("label").alias("class_fp"), "class_id", "class_size")
    return sketch.select("doc_id", "fp").join(classed, "fp")


def _links(docs: DataFrame, members: DataFrame, threshold: float, size: int, text_col: str) -> DataFrame:
    """Verified links between nodes that share a bucket; ``members`` has key, fp and the size of the bucket."""
    weight = members.groupBy("fp").agg(F.sum("size").alias("weight"))
    weighted = members.select("key", "fp").join(weight, "fp")
    centre = weighted.groupBy("key").agg(F.max(F.struct("weight", "fp"))["fp"].alias("centre"))
    star = store(members.select("key", "fp").join(centre, "key").select("centre", "fp").distinct(), "stars")
    texts = store(_texts(docs, star.select("fp").distinct(), text_col), "texts")

    # an upper bound of the shingles is enough to cut blocks: two bytes of text for a word and a blank
    length = texts.select("fp", (F.octet_length("text") / 2).alias("n"))
    sized = star.join(length, "fp")
    blocks = sized.groupBy("centre").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    blocks = store(blocks, "blocks")  # as a table of known size, so that a star of many texts can be split in the join
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    units = star.join(blocks, "centre").select("centre", "fp", block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    unit = F.concat_ws(":", F.hex("centre"), F.least("i", "j"), F.greatest("i", "j"))
    dealt = units.select(unit.alias("unit"), "fp").join(texts, "fp")
    dealt = dealt.repartition(partitions(docs.sparkSession), "unit").sortWithinPartitions("unit")
    return star_links(dealt, threshold, size)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id; of repeated rows, one."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    classes = near_duplicate_classes(docs, **options)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = store(kept.groupBy("class_fp", "doc_id").agg(F.min("fp").alias("fp"), F.count("*").alias("__rows")), "kept")
    marked = docs.withColumn("__fp", fingerprint(text_col))
    mine = kept.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__kept"), "__rows")
    on = (marked["__fp"] == mine["__kept"]) & marked[id_col].eqNullSafe(mine["__id"])
    left = marked.join(mine, on)
    once = left.where("__rows = 1")
    if kept.where("__rows > 1").isEmpty():  # ids are unique as a rule: nothing to collapse
        return once.select(*docs.columns)
    again = left.where("__rows > 1").dropDuplicates(["__id", "__kept"])
    return once.union(again).select(*docs.columns)
