"""Text batches inside Spark tasks: Arrow columns to NumPy, words, hashes and shingles.

Every helper takes whole texts and works on a few megabytes at a time, so the memory of a task is bounded
by the slice limit or by its longest text. A null text counts as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5
#: Words are separated by these characters (fixed by the contracts of the queries).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def store(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def beside_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The text, and all other columns as one: their names can't clash with those that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*rest, F.lit(0).alias("__none")).alias("__row"), F.col(text_col))


def as_before(rows: DataFrame, docs: DataFrame, text: Column, text_col: str = "text") -> DataFrame:
    """Rows of ``beside_text`` in the columns of ``docs``, with this text; ``n_chars`` follows it."""
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("__row")[c].alias(c))
    return rows.select(*columns)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into this fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that their texts hold about ``limit`` bytes, one row at least; skips empty ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            grown = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown)
    return _powers[0][:n], _powers[1][:n]


def word_bounds(
    data: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``, or of every run of bytes marked ``inside``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_IS_SPACE[data] if inside is None else inside
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    row = np.searchsorted(at, starts, "right") - 1
    return starts, np.flatnonzero(ends) + 1, row


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one running polynomial sum."""
    powers, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def shingles(word: np.ndarray, row: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words inside one row, in order."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = row[:n] == row[size - 1 :]
    joined = word[:n].copy()
    for j in range(1, size):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + word[j : n + j]
    return mix(joined[whole]), row[:n][whole]


def text_shingles(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(column)
    starts, ends, row = word_bounds(data, at)
    return shingles(span_hashes(data, starts, ends), row, size)
