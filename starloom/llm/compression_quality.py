"""Text quality by compression: dictionaries of good and bad text, and the difference of compressed sizes.

A zstandard dictionary is trained on pieces of texts of each label. A text that resembles one label is
coded shorter with that dictionary; the difference, divided by the larger size, does not depend on the
length. It is calibrated to a probability by logistic regression, together with how well the text is coded
with no dictionary at all (degenerate text repeats itself) and with each of them per byte, on labelled texts
that were not used for the dictionaries. Both samples are bounded by parameters; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.llm.batches import sliced, store

SAMPLE = 4_000  # labelled texts of each label, about
PIECE, PIECES = 2_048, 4_000  # characters of a training piece; pieces of each label, about
DICTIONARY_BYTES = 65_536
LEVEL = 3
_compressors: dict[tuple, list] = {}


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes]  # of label 0 and label 1
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = (features(sizes) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _dictionary(pieces: list[bytes]) -> bytes:
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself
        return b"".join(pieces)[:DICTIONARY_BYTES]


def _compress(dictionaries: tuple[bytes, bytes]) -> list:
    """Compressors of this worker process: no dictionary, bad, good."""
    key = tuple(map(hash, dictionaries))
    if key not in _compressors:
        made = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]
        for data in dictionaries:
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_dict_id=False, write_content_size=False))
        _compressors.clear()
        _compressors[key] = made
    return _compressors[key]


def compressed_sizes(column: pa.Array, dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Bytes of each text, and compressed with no, the bad and the good dictionary."""
    out = np.zeros((len(column), 4))
    plain, bad, good = _compress(dictionaries)
    for i, text in enumerate(column):
        raw = text.as_buffer() if text.is_valid else b""
        out[i] = len(raw), len(plain.compress(raw)), len(bad.compress(raw)), len(good.compress(raw))
    return out


def features(sizes: np.ndarray) -> np.ndarray:
    n, plain, bad, good = np.maximum(sizes, 1).T
    difference = (bad - good) / np.maximum(bad, good)
    ratio = np.log((plain + 1) / (n + 20))
    gain = np.log(good / plain), np.log(bad / plain)
    length = np.log(n)
    return np.stack([difference, ratio, *gain, length, difference * length, ratio * length, ratio**2], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps, each halved until the loss falls."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [0.0])

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float((np.logaddexp(0, t) - y * t).sum() + 0.5 * w @ penalty @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        while np.abs(step).max() >= 1e-8 and loss(w - step) > now:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        w = w - step
        now = loss(w)
    return centre, scale, w


def sample_labelled(
    docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """About ``sample`` labelled texts of each value 0 and 1: text, y, id. Rows of a null label, id or text are left out.

    Of repeated labels of one id the larger one counts; repeated documents of one id are all taken. Other columns of
    either table may have any name. Documents are chosen by a hash of their id, so the chosen ids are bounded and sent to all tasks.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("y"))
    per = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not per:
        return docs.select(F.col(text_col).cast("string").alias("text"), F.lit(0).alias("y"), F.col(id_col).alias("id")).limit(0)
    share = F.create_map(*(F.lit(x) for y, n in per.items() for x in (y, min(1.0, sample / n))))
    chance = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(known.where(chance < share[F.col("y")]))  # about two samples of (id, y)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.join(chosen, F.col("__doc") == F.col("__id")).select("text", "y", F.col("__id").alias("id"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Dictionaries from one half of the labelled sample, calibration on the other half; None without rows."""
    chosen = sample_labelled(docs, labels, label, sample)
    chosen = store(chosen.withColumn("half", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2))), "labelled")
    cut = F.expr(f"transform(sequence(0, (length(text) - 1) div {PIECE}), i -> substring(text, i * {PIECE} + 1, {PIECE}))")
    pieces = chosen.where("half = 0 and length(text) > 0").select("y", F.explode(cut).alias("piece"))
    per = {r["y"]: r["count"] for r in pieces.groupBy("y").count().collect()}
    if set(per) != {0, 1}:
        return None
    share = F.create_map(*(F.lit(x) for y, n in per.items() for x in (y, min(1.0, PIECES / n))))
    chance = F.pmod(F.xxhash64("piece", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    kept = pieces.where(chance < share[F.col("y")]).orderBy("y", "piece").collect()
    dictionaries = tuple(_dictionary([r["piece"].encode() for r in kept if r["y"] == y]) for y in (0, 1))

    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 0):
            sizes = compressed_sizes(part.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(sizes[:, j]) for j in range(4))], list("yabcd"))

    rows = chosen.where("half = 1").select("text", "y").mapInArrow(measure, "y int, a double, b double, c double, d double").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    sizes, y = np.array([r[1:] for r in rows]), np.array([r["y"] for r in rows], float)
    return Model(dictionaries, *fit_logistic(features(sizes), y))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``.

    A null text counts as empty. Without a model every score is 0.5. Columns of the new names are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*names)
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in sliced(batches, at):
            value = m.score(compressed_sizes(part.column(at), m.dictionaries)) if m else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], [*names, "score", "predicted"]
            )

    return docs.mapInArrow(apply, StructType([*docs.schema.fields]).add("score", "double").add("predicted", "integer"))
