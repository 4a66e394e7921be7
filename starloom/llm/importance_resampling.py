"""Importance resampling towards a target: scores from arrays of bucket gains, a cutoff by bisection, ranks by ranges.

Words and word pairs fall into hashed buckets. One pass counts the buckets of all documents and of all target
texts; their log ratios are the gains, and the weight of a document is the mean gain of its features. Seeded Gumbel
noise turns weights into a draw without replacement: the highest scores are drawn. The cutoff is found by counting:
jobs count the persisted scores up to the midpoints of the halvings to come until one score is left, then the ids of
the documents tied there in the same way. Only drawn rows are sorted, in ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.batches import partitions, sliced, store, utf8, word_bounds

BUCKETS = 10_000
PERCENT = 25
MIN_WORDS = 20
SEED = "7"
#: Halvings that one counting job settles.
LEVELS = 4
#: Words longer than this are hashed one by one.
LONG_WORD = 64

_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_TABLE = _byte_table()


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on each of the four bytes."""
    out = tables[0][crc & 255]
    for i in range(1, 4):
        out = out ^ tables[i][(crc >> np.uint32(8 * i)) & 255]
    return out


def _shift_tables() -> list[np.ndarray]:
    """Maps that append 1, 2, 4, ... zero bytes to what a checksum covers."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    tables = [_TABLE[one & 255] ^ (one >> np.uint32(8))]
    while len(tables) < 40:
        tables.append(np.stack([_through(tables[-1], row) for row in tables[-1]]))
    return tables


_SHIFTS = _shift_tables()


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every span, all spans one byte further at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], starts[order]
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    many = np.searchsorted(-size, -LONG_WORD, "left")  # these are longer than LONG_WORD
    for j in range(int(size[many]) if many < len(size) else 0):
        live = int(np.searchsorted(-size, -j, "left"))
        part = crc[many:live]
        crc[many:live] = _TABLE[(part ^ data[begin[many:live] + j]) & 255] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(many):
        crc[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def joined_crcs(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """crc32 of ``left + b" " + right`` from the checksums of both."""
    blank = np.uint32(zlib.crc32(b" "))
    crc, size = _through(_SHIFTS[0], left) ^ blank, right_size.astype(np.int64)
    for bit in range(int(size.max()).bit_length() if len(size) else 0):
        has = np.flatnonzero(size >> bit & 1)
        crc[has] = _through(_SHIFTS[bit], crc[has])
    return crc ^ right


def text_features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every word and word pair, and the number of words of every row."""
    data, at = utf8(column)
    data = _LOWER[data]
    starts, ends, row = word_bounds(data, at, _WORD[data])
    word = span_crcs(data, starts, ends)
    pair = np.flatnonzero(row[1:] == row[:-1])
    pairs = joined_crcs(word[pair], word[pair + 1], (ends - starts)[pair + 1])
    bucket = np.concatenate([word, pairs]) % np.uint32(buckets)
    return bucket.astype(np.int64), np.concatenate([row, row[pair]]), np.bincount(row, minlength=len(column))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task adds up its own, the driver gets one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in sliced(batches, text=0):
            total += np.bincount(text_features(part.column(0), buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    got = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to source share of each bucket."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    top, low = [(int(x) + 1) * (s + n) for x in target], [(int(x) + 1) * (t + n) for x in source]
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(top, low, strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for part in sliced(batches):
            bucket, row, n_words = text_features(part.column(1), len(gain))
            n = np.bincount(row, minlength=part.num_rows)
            # sums of whole numbers below 2**53 are exact in doubles
            total = np.bincount(row, weights=gain[bucket].astype(np.float64), minlength=part.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 g) with g Gumbel noise of a hash of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_smallest(rows: DataFrame, value: Column, k: int) -> tuple[int, int]:
    """The k-th smallest whole number of ``value`` (1 <= k <= rows) and how many rows are below it.

    Every job counts the rows up to the midpoints of the next ``LEVELS`` halvings, exactly and over all rows.
    """
    rows = rows.select(value.alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        cuts = {low, high}
        for _ in range(LEVELS):
            edge = sorted(cuts)
            cuts |= {(a + b) // 2 for a, b in zip(edge, edge[1:], strict=False)}
        mids = sorted(cuts - {high})
        counts = list(rows.agg(*[F.count_if(F.col("v") <= F.lit(m)) for m in mids]).first())
        at = next((i for i, c in enumerate(counts) if c >= k), len(mids))
        if at:
            low, below = mids[at - 1] + 1, counts[at - 1]
        if at < len(mids):
            high = mids[at]
    return low, below


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` (a stored table of doc_id, n_words, n_features, weight, score) with rank: 1, 2, 3 ... for the
    floor(percent * N / 100) highest scores of the N rows of ``min_words`` words, null for all others."""
    spark = scored.sparkSession
    may = F.col("n_words") >= min_words
    pool = scored.where(may)
    wanted = percent * pool.count() // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", none)
    tie = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    cut, above = kth_smallest(pool, -F.col("score"), wanted)
    last, _ = kth_smallest(pool.where(F.col("score") == -cut), tie, wanted - above)
    # rows of one id and one score are drawn together here; ranks beyond ``wanted`` are taken back below
    drawn = may & ((F.col("score") > -cut) | (F.col("score") == -cut) & (tie <= last))
    order = [F.col("score").desc(), tie.asc(), F.col("row")]
    ranges = scored.where(drawn).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = store(ranges.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # one row for each shuffle partition
    rank = F.col("before") + inside + 1
    ranked = placed.join(F.broadcast(sizes), part == F.col("part"))
    ranked = ranked.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return scored.where(~drawn).select("*", none).union(ranked)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """Every document with doc_id, n_words, n_features, weight, score and rank (null if it is not drawn).

    Words are runs of digits, lower-cased letters a to z and characters beyond ASCII; features are words and pairs of
    neighbours. Ids are whole numbers; ties of a score go to the smaller id, a null id comes last (its noise is that of
    an empty id), and rows of one id and score are ranked in any order. Null and empty texts have no features, weight 0
    and are never drawn. Repeated rows count each. Texts are read whole at any length. Other columns are not read; an
    empty table of documents gives an empty result, and without target texts all gains come from smoothing alone.
    """
    source = bucket_counts(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), buckets)
    wanted = bucket_counts(target.select(F.coalesce(F.col(target_text).cast("string"), F.lit("")).alias("text")), buckets)
    weighed = weights(docs, bucket_gains(source, wanted), id_col, text_col)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(store(scored.withColumn("row", F.monotonically_increasing_id()), "scored"), percent, min_words).drop("row")
