"""Packing of token sequences: shortest-pack-first over the length histogram.

The histogram of piece lengths has at most ``max_len`` rows at any corpus size, so it alone goes to the
driver. Lengths are placed longest first: a length joins the packs with the most free room, and the counts
of packing patterns are updated instead of single packs. Each pattern then stands for a run of sequence
ids, and each (length, rank) falls into one slot of one pattern; documents are joined back by their rank
among the pieces of the same length. Ranks come from windows over (length, bucket) and bucket offsets, so
a length that holds a third of all pieces is spread over all buckets.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from starloom.llm.batches import partitions, sliced, store
from starloom.llm.bpe import cached_bpe

MAX_LEN = 4096
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every document with the end id, cut into pieces of at most ``max_len`` ids.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text gives the end id alone. Other
    columns of ``docs`` are not read; a null id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cached_bpe(tokenizer_path)
        for part in sliced(batches):
            ids, sizes = bpe.encode(part.column(1).to_pylist())
            n = -(-sizes // max_len)
            row = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * max_len
            length = np.minimum(max_len, sizes[row] - start)
            offsets = np.concatenate([[0], np.cumsum(length)]) * 4
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sizes[row]),
                 data.cast(pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE_SCHEMA)


def packing_patterns(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, list[int]]]:
    """Patterns with their counts: (packs, lengths of a pack). Each length is used as often as it occurs.

    ``free`` holds the patterns that still have room, by room; a pattern is a chain (length, rest).
    """
    free: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= max_len:
            raise ValueError(f"length {length} is not in 1..{max_len}")
        left, made = histogram[length], []
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            packs, chain = free[room].pop()
            used = min(packs, left)
            if used < packs:
                free[room].append((packs - used, chain))
            if not free[room]:
                del free[room]
                rooms.pop()
            left -= used
            made = [(room - length, used, (length, chain))]
            _offer(free, rooms, made)
        if left:
            fit = max_len // length  # new packs take as many of this length as fit
            whole, rest = divmod(left, fit)
            for packs, times in ((whole, fit), (1, rest)):
                if packs and times:
                    chain = None
                    for _ in range(times):
                        chain = (length, chain)
                    _offer(free, rooms, [(max_len - times * length, packs, chain)])
    out = []
    for room in rooms:
        for packs, chain in free[room]:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            out.append((packs, lengths[::-1]))
    return out


def _offer(free: dict, rooms: list[int], made: list[tuple[int, int, tuple]]) -> None:
    for room, packs, chain in made:
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append((packs, chain))


def pattern_slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length its slots: ranks from ``rank`` on lie in sequences from ``sequence`` on, at ``offset``."""
    packs = np.array([p for p, _ in patterns], np.int64)
    sizes = np.array([len(x) for _, x in patterns], np.int64)
    length = np.array([x for _, lengths in patterns for x in lengths], np.int64)
    count = np.repeat(packs, sizes)
    sequence = np.repeat(np.cumsum(packs) - packs, sizes)
    ends = np.cumsum(length)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    offset = ends - length - (ends - length)[first] if len(length) else length
    order = np.argsort(length, kind="stable")
    length, count, sequence, offset = length[order], count[order], sequence[order], offset[order]
    before = np.cumsum(count) - count
    start = np.searchsorted(length, length, "left")
    rank = before - before[start] if len(length) else before
    return {"length": length, "rank": rank, "sequence": sequence, "offset": offset}


def place(pieces: DataFrame, key: list[str], length_col: str = "length", max_len: int = MAX_LEN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a length of 1 to ``max_len``; ``key`` orders equal lengths.

    ``pieces`` is read twice, so it should be a table. All its columns are kept, but those of the two new
    names are replaced. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counted = pieces.groupBy(F.col(length_col).cast("long").alias("len")).count().collect()  # max_len rows at most
    slots = pattern_slots(packing_patterns({r["len"]: r["count"] for r in counted}, max_len))
    shared = spark.sparkContext.broadcast(slots)

    bucket = F.pmod(F.xxhash64(*key), F.lit(max(64, partitions(spark))))
    ranked = pieces.withColumn("__bucket", bucket).withColumn(
        "__local", F.row_number().over(Window.partitionBy(length_col, "__bucket").orderBy(*key)) - 1
    )
    in_bucket = ranked.groupBy(length_col, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(length_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_bucket.select(
        length_col, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    ranked = ranked.join(offsets, [length_col, "__bucket"]).withColumn(
        "__rank", (F.col("__local") + F.col("__before")).cast("long")
    )

    schema = pieces.schema
    names = pieces.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            length = batch.column(names.index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            # slots are ordered by (length, rank): the last one at or before the row's rank is its own
            low = np.searchsorted(s["length"], length, "left")
            high = np.searchsorted(s["length"], length, "right")
            while np.any(open_ := high - low > 1):
                middle = (low + high) // 2
                right = open_ & (s["rank"][np.minimum(middle, len(s["rank"]) - 1)] <= rank)
                low, high = np.where(right, middle, low), np.where(open_ & ~right, middle, high)
            sequence = s["sequence"][low] + rank - s["rank"][low]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(s["offset"][low])],
                [*names, "sequence_id", "offset"],
            )

    out = StructType([*schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.select(*names, "__rank").mapInArrow(look_up, out)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, keep_ids: bool = True, name: str = "pieces"
) -> DataFrame:
    """Documents packed into sequences of at most ``max_len`` ids, one row for each piece.

    Columns: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and the ids if wanted.
    Repeated rows are packed as often as they occur; ties of length go by (doc_id, start).
    """
    pieces = token_pieces(docs, tokenizer_path, max_len).withColumn("ids_crc32", F.crc32("ids"))
    pieces = store(pieces if keep_ids else pieces.drop("ids"), name)
    return place(pieces, ["doc_id", "start"], "length", max_len)
