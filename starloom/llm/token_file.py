"""Binary token files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Documents are dealt by ranges of their id and encoded in ascending order. A file is a Parquet container of
segments of about ``SEGMENT_IDS`` ids. Each segment is complete in itself: its ids by falling frequency
(``table``), the document ids and sizes, and the ids as ranks, with one control byte for four ranks
(two bits each: bytes of the rank less one) apart from the data bytes. Ranks below 256 take one byte.
A segment needs neither a count over the corpus nor another segment, so files are written in one pass, and
a lost executor repeats its own segments only. Documents are never split; a longer one makes a longer segment.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.batches import partitions, sliced
from starloom.llm.bpe import cached_bpe
from starloom.session import ensure_checkpoint_dir

SEGMENT_IDS = 1 << 21
FILE_SCHEMA = (
    "part int, segment int, n_ids long, n_null int, doc_ids binary, doc_sizes binary, table binary, control binary, data binary"
)
DOC_SCHEMA = "doc_id long, part int, segment int, local_start long, n_tokens long, ids_crc32 long"

# Lookup tables by control byte: bytes of each of its four ranks less one, where they begin, all bytes together.
_CODE = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8)
_WIDTH = _CODE.astype(np.int64) + 1
_BEGIN = np.cumsum(_WIDTH, axis=1) - _WIDTH
_TOTAL = _WIDTH.sum(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes; the last control byte is filled up with zero bits and no data."""
    ranks = ranks.astype(np.uint32)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(code.max()) + 1 if len(code) else 1  # the vocabulary bounds it: two bytes as a rule
    if width <= 2:  # flat bytes of two each, without the upper ones that are not needed
        used = np.ones(2 * len(ranks), bool)
        used[1::2] = code
        data = ranks.astype("<u2").view(np.uint8)[used]
    else:
        used = np.arange(width, dtype=np.uint8)[None, :] <= code[:, None]
        data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width][used]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks by table lookup of the control bytes."""
    c = np.frombuffer(control, np.uint8)
    total = _TOTAL[c]
    at = ((np.cumsum(total) - total)[:, None] + _BEGIN[c]).ravel()[:n]
    code = _CODE[c].ravel()[:n]
    held = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    word = held[at].astype(np.uint32)
    for j in range(1, int(code.max()) + 1 if n else 1):
        word |= np.where(code >= j, held[at + j], 0).astype(np.uint32) << np.uint32(8 * j)
    return word


def _segment(part: int, number: int, ids: np.ndarray, doc_ids: list, sizes: list) -> dict:
    times = np.bincount(ids)
    table = np.flatnonzero(times)
    table = table[np.argsort(-times[table], kind="stable")]
    rank = np.zeros(len(times), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = encode_ranks(rank[ids])
    return {
        "part": part, "segment": number, "n_ids": len(ids), "n_null": doc_ids.count(None),
        "doc_ids": np.array([i or 0 for i in doc_ids], "<i8").tobytes(), "doc_sizes": np.array(sizes, "<u8").tobytes(),
        "table": table.astype("<u4").tobytes(), "control": control, "data": data,
    }


def write_token_file(
    docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Writes the token file of all documents in ascending order of their id.

    A null or empty text has the end id alone. Null ids come first, and each segment says how many of its
    documents have none; repeated ids are kept side by side, ordered by a hash of their text. Other columns are not read.
    """
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("n_null", pa.int32()),
                        *((c, pa.binary()) for c in ("doc_ids", "doc_sizes", "table", "control", "data"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cached_bpe(tokenizer_path)
        part, number, held, doc_ids, sizes, n = TaskContext.get().partitionId(), 0, [], [], [], 0
        for cut in sliced(batches):
            ids, size = bpe.encode(cut.column(1).to_pylist())
            held.append(ids.astype(np.uint32))
            doc_ids += cut.column(0).to_pylist()
            sizes += size.tolist()
            n += len(ids)
            if n >= segment_ids:
                yield pa.RecordBatch.from_pylist([_segment(part, number, np.concatenate(held), doc_ids, sizes)], schema)
                number, held, doc_ids, sizes, n = number + 1, [], [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_segment(part, number, np.concatenate(held), doc_ids, sizes)], schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]  # the hash spreads the rows of one id over tasks
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # the codes are close to their entropy: a light second compression by the container is enough
    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def _decoded(row: dict) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    table = np.frombuffer(row["table"], "<u4")
    ids = table[decode_ranks(row["control"], row["data"], row["n_ids"])]
    doc_ids = np.frombuffer(row["doc_ids"], "<i8")
    return ids, pa.array(doc_ids, mask=np.arange(len(doc_ids)) < row["n_null"]), np.frombuffer(row["doc_sizes"], "<u8").astype(np.int64)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token file with their ids: doc_id, ids array<long>."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, doc_ids, sizes = _decoded(row)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return segments(spark, path).mapInArrow(decode, "doc_id long, ids array<long>")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before. It is the sum of whole parts (one row for each part,
    so it is bounded by the partitions of the writer), of earlier segments of the part and of earlier
    documents of the segment.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, doc_ids, sizes = _decoded(row)
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array([row["part"]] * n, pa.int32()),
                     pa.array([row["segment"]] * n, pa.int32()), pa.array(at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "segment", "local_start", "n_tokens", "ids_crc32"],
                )

    sizes = segments(spark, path).select("part", "segment", "n_ids")
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = sizes.select(
        "part", "segment", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("segment_start")
    ).join(parts, "part")
    docs = segments(spark, path).mapInArrow(decode, DOC_SCHEMA)
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("local_start") + F.col("segment_start") + F.col("part_start")).cast("long").alias("start"),
        "n_tokens", "ids_crc32",
    )


def token_file_digests(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes the token file and reads it back."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/tokens"
    write_token_file(docs, tokenizer_path, path)
    return read_token_digests(spark, path)
