"""Language by prediction by partial matching.

Each language has a tree of byte contexts of variable order with the symbols that followed them. A symbol
that a context has not seen costs an escape (method C: distinct symbols against occurrences) and is coded
by the next shorter context, down to a uniform code over all bytes. Statistics are frozen after training,
so the code length of a symbol depends on the context and the symbol only: the trees of all languages are
compiled into one table (context, symbol) -> bits per language, and a text is scored by table lookups over
its bytes. The language with the shortest code wins.

The training sample and the number of contexts are bounded by parameters; the model has at most
``contexts`` x 257 x languages entries of two bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.llm.batches import sliced, store, utf8

TRAINING_DOCS = 2_000  # of each language, about
CONTEXTS = 16_384  # of orders two and three, the most frequent ones; orders zero and one are complete
ORDER = 3
BITS_SCALE = 256  # code lengths are kept in 1/256 bit


def _history(data: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """The bytes 1, 2, .. ``order`` places before each byte; zero before the start of a text."""
    out = []
    for k in range(1, order + 1):
        back = np.zeros(len(data), np.int64)
        back[k:] = data[:-k] if k < len(data) else data[:0]
        for j in range(k):
            edge = at[:-1] + j
            back[edge[edge < at[1:]]] = 0
        out.append(back)
    return out


def _count(rows: DataFrame) -> DataFrame:
    """lang, order, context (its bytes as a number, the nearest one lowest), symbol, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            langs = part.column(0).to_pylist()
            names = sorted(set(langs))
            data, at = utf8(part.column(1))
            lang = np.repeat([names.index(x) for x in langs], np.diff(at))
            back = _history(data, at, ORDER)
            context = np.zeros(len(data), np.int64)
            for order in range(ORDER + 1):
                if order:
                    context = context | back[order - 1] << (8 * (order - 1))
                key, n = np.unique((lang << 40) | (context << 8) | data, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in (key >> 40).tolist()], pa.string()),
                     pa.array(np.full(len(key), order, np.int32)), pa.array((key >> 8) & 0xFFFFFFFF),
                     pa.array((key & 0xFF).astype(np.int32)), pa.array(n)],
                    ["lang", "order", "context", "symbol", "n"],
                )

    counted = rows.mapInArrow(count, "lang string, order int, context long, symbol int, n long")
    return counted.groupBy("lang", "order", "context", "symbol").agg(F.sum("n").alias("n"))


class Model:
    """The compiled trees. ``state`` gives the longest known context behind three symbols."""

    def __init__(self, counts: pa.Table) -> None:
        lang = counts["lang"].to_pylist()
        self.langs = sorted(set(lang))
        place = {x: i for i, x in enumerate(self.langs)}
        lang = np.array([place[x] for x in lang], np.int64)
        order, context, symbol, n = (counts[c].to_numpy().astype(np.int64) for c in ("order", "context", "symbol", "n"))
        known = np.unique(symbol)
        size = len(known) + 1  # symbol 0 is any other byte, and what stands before a text
        self.size = size
        self.code = np.zeros(256, np.int32)
        self.code[known] = np.arange(1, size)
        symbol = self.code[symbol].astype(np.int64)
        parts = [self.code[(context >> (8 * k)) & 255].astype(np.int64) for k in range(ORDER)]

        n_lang = len(self.langs)
        bits = np.full((1, size, n_lang), 8.0)  # the uniform code below order zero
        states, rows = [np.zeros(1, np.int64)], [bits]
        for k in range(ORDER + 1):
            mine = order == k
            place_in = sum((parts[j][mine] * size**j for j in range(k)), np.zeros(int(mine.sum()), np.int64))
            contexts = np.unique(place_in)
            seen = np.zeros((len(contexts), size, n_lang), np.float32)
            np.add.at(seen, (np.searchsorted(contexts, place_in), symbol[mine], lang[mine]), n[mine])
            total, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            # the next shorter context drops the byte that lies farthest back
            shorter = rows[-1][self._find(states[-1], contexts % size ** (k - 1))] if k else bits
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = -np.log2(seen / (total + distinct))
                escape = -np.log2(distinct / (total + distinct)) + shorter
            own = np.where(seen > 0, hit, np.where(total > 0, escape, shorter))
            rows.append(own.astype(np.float32))
            states.append(contexts)
        self.table = np.clip(np.round(np.concatenate(rows[1:]) * BITS_SCALE), 0, 32767).astype(np.int16).reshape(-1, n_lang)
        at = np.cumsum([0, *map(len, states[1:])])
        # compiled once: three symbols back -> the longest known context
        state = np.full(1, at[0], np.int32)
        for k in range(1, ORDER + 1):
            longer = np.tile(state, size)
            longer[states[k + 1]] = at[k] + np.arange(len(states[k + 1]))
            state = longer
        self.state = state

    @staticmethod
    def _find(states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Every context kept has its shorter one kept: it is at least as frequent."""
        return np.minimum(np.searchsorted(states, wanted), len(states) - 1)

    def bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        symbol = self.code[data].astype(np.int64)
        back = _history(symbol, at, ORDER)
        place = back[ORDER - 1]
        for k in range(ORDER - 2, -1, -1):
            place = place * self.size + back[k]
        lengths = self.table[self.state[place].astype(np.int64) * self.size + symbol]
        out = np.zeros((len(at) - 1, len(self.langs)))
        some = np.flatnonzero(np.diff(at))
        if len(some):
            out[some] = np.add.reduceat(lengths, at[some], axis=0, dtype=np.int64)
        return out / BITS_SCALE


def train(docs: DataFrame, sample: int = TRAINING_DOCS, contexts: int = CONTEXTS) -> Model | None:
    """``docs``: lang and text. About ``sample`` documents of each language are taken by a hash of the text."""
    rows = docs.where("lang is not null and text is not null")
    per_lang = rows.groupBy("lang").count().collect()  # one row for each language
    if not per_lang:
        return None
    share = F.create_map(*(F.lit(x) for r in per_lang for x in (r["lang"], min(1.0, sample / r["count"]))))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(chance < share[F.col("lang")]).select("lang", "text")
    counts = store(_count(chosen), "contexts")
    long = counts.where("order >= 2").groupBy("order", "context").agg(F.sum("n").alias("total"))
    kept = long.orderBy(F.desc("total"), "order", "context").limit(contexts).select("order", "context")
    all_kept = counts.where("order < 2").union(
        counts.join(kept, ["order", "context"], "left_semi").select(counts.columns)
    )
    table = all_kept.toArrow()
    return Model(table) if table.num_rows else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, its share among the languages.

    ``und`` with score 0 for null texts, texts without a letter, and if nothing was learned. The score is
    2 to the minus code length, normalised. Columns of the new names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    at_text = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in sliced(batches, at_text):
            data, at = utf8(part.column(at_text))
            n = part.num_rows
            letter = ((data | 32) - 97 < 26).astype(np.int64)
            count = np.concatenate([[0], np.cumsum(letter)])
            has = count[at[1:]] > count[at[:-1]]
            for r in np.flatnonzero(~has & (np.diff(at) > 0)).tolist():
                has[r] = any(c.isalpha() for c in part.column(at_text)[r].as_py())
            pred, score = ["und"] * n, np.zeros(n)
            if m is not None:
                bits = m.bits(data, at)
                best = bits.argmin(1)
                score = np.where(has, 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1), 0.0)
                pred = [m.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(apply, schema)

