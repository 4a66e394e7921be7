"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled texts, as unit vectors over all their words and over the beginnings
that go with a label. Document frequencies are those of all documents; words that go with neither label count
by ``PLAIN`` of their idf, as a toxic text is mostly plain. The inverted index is cut into blocks of examples;
for each of the most frequent terms and each block it keeps the largest weight, the postings of rarer terms are
summed outright. The sum of both bounds every cosine in a block, so blocks are searched by falling bound until
the bound is below the k-th best cosine: the neighbours are exact. They vote by their cosine, and the vote is
calibrated on the examples themselves, each without its own vote. Only texts that share no term with any example
have no neighbour; they get the share of the label among examples like that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.llm.batches import mix, sliced, span_hashes, store, utf8, word_bounds
from starloom.llm.compression_quality import fit_logistic, sample_labelled

SAMPLE = 3_000  # labelled texts of each label, about
TERMS, MIN_ASSOCIATION = 1_024, 20.0  # most terms with a table of all blocks, least G statistic to go with a label
PLAIN = 0.05  # weight of a term that goes with neither label
#: A term needs so many examples, at any size of the sample.
MIN_DOCS = 8
BEGINNINGS = (4, 5, 6)  # bytes
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 16, 64, 3
FREQUENT = 2_048  # terms with a table, if fewer go with a label; the most frequent words fill up
GROUP = 32  # texts searched together
CACHED = 4_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = np.zeros(256, bool)  # letters, digits and all bytes of other scripts
_PART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Lowered bytes of the texts with start, end, row and hash of each term: first the words, whose number comes
    last, and then the beginnings of longer words, which inflected and compound words share."""
    data, at = utf8(column)
    data = _LOWER[data]
    starts, ends, row = word_bounds(data, at, _PART[data])
    longer = [np.flatnonzero(ends - starts > n) for n in BEGINNINGS]
    all_starts = np.concatenate([starts, *(starts[i] for i in longer)])
    all_ends = np.concatenate([ends, *(starts[i] + n for i, n in zip(longer, BEGINNINGS, strict=True))])
    h = span_hashes(data, all_starts, all_ends)
    h[len(starts) :] = mix(h[len(starts) :])  # a beginning is another term than the word of the same letters
    return data, all_starts, all_ends, np.concatenate([row, *(row[i] for i in longer)]), h, len(starts)


def presences(chosen: DataFrame) -> DataFrame:
    """Each term of the examples (text, y): its hash, whether it is a word, examples with it (n), those of label 1 (a)."""

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 0):
            data, starts, ends, row, h, n_words = terms(part.column(0))
            y = part.column(1).to_numpy().astype(np.int64)
            pair, first = np.unique(np.stack([h, row.astype(np.uint64)]), axis=1, return_index=True)
            value, at, inverse = np.unique(pair[0], return_index=True, return_inverse=True)
            n = np.bincount(inverse, minlength=len(value))
            toxic = np.bincount(inverse, weights=y[row[first]], minlength=len(value)).astype(np.int64)
            raw = data.tobytes()
            words = [raw[starts[i] : ends[i]].decode(errors="replace") for i in first[at].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(value.view(np.int64)), pa.array(first[at] < n_words), pa.array(n), pa.array(toxic)],
                ["term", "h", "word", "n", "n1"],
            )

    return chosen.select("text", "y").mapInArrow(presence, "term string, h long, word boolean, n long, n1 long").groupBy("h").agg(
        F.min("term").alias("term"), F.max("word").alias("word"), F.sum("n").alias("n"), F.sum("n1").alias("a")
    )


def vocabulary(chosen: DataFrame, most: int = TERMS, counted: DataFrame | None = None) -> list[tuple[str, int, float]]:
    """(term, hash, idf) of the terms that go most with either label, by the G statistic of their presence."""
    total = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return []
    counted = presences(chosen) if counted is None else counted
    cells = [("a", n1), ("n - a", n0), (f"{n1} - a", n1), (f"{n0} - (n - a)", n0)]
    rows = ["n", "n", f"{n0 + n1} - n", f"{n0 + n1} - n"]
    g = " + ".join(
        f"if(({x}) > 0, ({x}) * ln(({x}) * {n0 + n1}D / (greatest({r}, 1) * {c}D)), 0D)" for (x, c), r in zip(cells, rows, strict=True)
    )
    best = counted.where(F.col("n") >= MIN_DOCS).withColumn("g", F.expr(f"2 * ({g})")).where(F.col("g") >= MIN_ASSOCIATION)
    top = best.orderBy(F.desc("g"), "term").limit(most).collect()
    return [(r["term"], r["h"], float(np.log((n0 + n1) / r["n"]) + 0.1)) for r in top]


Vector = np.ndarray | list[tuple[int, int]]


class Index:
    """Block-max inverted index of the examples; ``vectors`` are (term number, count).

    ``words`` are the terms with a table of all blocks: text (empty for words that go with no label), hash, weight. The terms of ``rest`` (hashes and
    weights), numbered behind them, have lists of postings.
    """

    def __init__(
        self, words: list[tuple[str, int, float]], ids: list, labels: np.ndarray, vectors: list[Vector],
        rest: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0)),
    ) -> None:
        self.terms = [w[0] for w in words]
        hashes = np.array([w[1] for w in words], np.int64).view(np.uint64)
        self.tables = np.sort(hashes), np.argsort(hashes)
        hashes = np.concatenate([hashes, rest[0]])
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        self.idf = np.concatenate([np.array([w[2] for w in words], float), rest[1]])
        vectors = [np.asarray(v, np.int32).reshape(-1, 2) for v in vectors]
        # examples with the same leading term stand together, so that bounds of blocks differ
        lead = [t[self.idf[t].argmax()] if len(t) else len(words) for t in (v[v[:, 0] < len(words), 0] for v in vectors)]
        self.place = place = np.lexsort((np.arange(len(ids)), lead))
        self.ids = [ids[i] for i in place]
        self.labels = labels[place].astype(float)
        self.blocks = -(-len(ids) // BLOCK) or 1
        # the postings of a term, block by block, and the largest one of each block
        self.posting = np.zeros((self.blocks, len(words), BLOCK), np.float32)
        of_rest = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))]
        for doc, i in enumerate(place):
            if len(vectors[i]):
                t, w = self.weights(vectors[i])
                has_table = t < len(words)
                self.posting[doc // BLOCK, t[has_table], doc % BLOCK] = w[has_table]
                rare = (t[~has_table] - len(words)).astype(np.int32)
                of_rest.append((rare, np.full(len(rare), doc, np.int32), w[~has_table].astype(np.float32)))
        term, doc, weight = (np.concatenate(x) for x in zip(*of_rest, strict=True))
        del of_rest
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(rest[0]) + 1))
        self.most = self.posting.max(2).T
        self.cache: dict[bytes, tuple] = {}
        self.calibration = (1.0, 0.0)
        self.base = 0.5
        self.id_type = "bigint" if all(isinstance(i, int) for i in ids) else "string"

    def weights(self, vector: Vector) -> tuple[np.ndarray, np.ndarray]:
        t, n = np.array(vector, np.int64).reshape(-1, 2).T
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def _rare(self, row: np.ndarray, t: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        """What the terms with lists of postings add to the cosine of each example, block by block."""
        size = self.at[t + 1] - self.at[t]
        i = np.repeat(self.at[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        width = self.blocks * BLOCK
        dots = np.bincount(np.repeat(row * width, size) + self.doc[i], np.repeat(w, size) * self.weight[i], rows * width)
        return dots.astype(np.float32).reshape(rows, self.blocks, BLOCK)

    def _add(self, query: np.ndarray, dots: np.ndarray, wanted: np.ndarray) -> None:
        for block in np.flatnonzero(wanted.any(0)).tolist():
            rows = np.flatnonzero(wanted[:, block])
            dots[rows, block] += query[rows] @ self.posting[block]

    def nearest(self, vectors: list[Vector], k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the k examples of largest cosine (ties: the first ones) and their cosines, all above zero."""
        out = []
        for start in range(0, len(vectors), GROUP):
            part = [np.array(v, np.int64).reshape(-1, 2) for v in vectors[start : start + GROUP]]
            m, row = len(part), np.repeat(np.arange(len(part)), [len(v) for v in part])
            t, n = np.concatenate(part).T
            w = (1 + np.log(n)) * self.idf[t]
            w = w / np.sqrt(np.bincount(row, w * w, m))[row]
            has_table = t < len(self.terms)
            query = np.zeros((m, len(self.terms)), np.float32)
            query[row[has_table], t[has_table]] = w[has_table]
            dots = self._rare(row[~has_table], t[~has_table] - len(self.terms), w[~has_table], m)
            bound = query @ self.most + dots.max(2)
            # the first blocks give a k-th best; then come all blocks that can still beat it
            wanted = np.zeros(bound.shape, bool)
            np.put_along_axis(wanted, np.argsort(-bound, 1, kind="stable")[:, :FIRST_BLOCKS], True, 1)
            self._add(query, dots, wanted)
            own = np.full(m, -1) if without is None else without[start : start + GROUP]
            mine = np.flatnonzero(own >= 0)
            known = np.where(wanted[:, :, None], dots, 0).reshape(m, -1)
            known[mine, own[mine]] = 0
            kth = np.partition(known, -min(k, known.shape[1]), 1)[:, -min(k, known.shape[1])]
            more = ~wanted & (bound > 0) & (bound >= kth[:, None] - 1e-4)
            self._add(query, dots, more)
            dots[~(wanted | more)] = 0
            dots = dots.reshape(m, -1)
            dots[mine, own[mine]] = 0
            kth = np.partition(dots, -min(k, dots.shape[1]), 1)[:, -min(k, dots.shape[1])]
            for score, least in zip(dots, kth.tolist(), strict=True):
                found = np.flatnonzero((score > 0) & (score >= least - 1e-4))
                best = found[np.lexsort((found, -score[found].round(5)))[:k]]
                out.append((best, score[best].astype(float)))
        return out

    def votes(self, vectors: list[Vector], without: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Log odds of each vote, shrunk where all neighbours are far, with the neighbours."""
        out = []
        for found, cosine in self.nearest(vectors, without=without):
            near = 1 / (1.05 - np.minimum(cosine, 1.0))  # the weight falls with the distance
            share = ((near * self.labels[found]).sum() + 0.5) / (near.sum() + 1.0)
            out.append((float(np.log(share / (1 - share))), found, cosine))
        return out

    def score(self, vectors: list[Vector]) -> list[tuple[float, list, list[float]]]:
        """Calibrated scores with the ids and cosines of the neighbours; equal texts are searched once."""
        keys = [np.array(v, np.int32).tobytes() for v in vectors]
        new = {key: v for key, v in zip(keys, vectors, strict=True) if key and key not in self.cache}
        if len(self.cache) + len(new) > CACHED:
            new = {key: v for key, v in zip(keys, vectors, strict=True) if key}
            self.cache.clear()
        for key, (logit, found, cosine) in zip(new, self.votes(list(new.values())), strict=True):
            z = self.calibration[0] * logit + self.calibration[1]
            self.cache[key] = (1 / (1 + np.exp(-np.clip(z, -30, 30))), [self.ids[i] for i in found], cosine.tolist())
        return [self.cache[key] if key else (self.base, [], []) for key in keys]

    def pairs(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row x number of terms + term, rising, with the count of the term in the text."""
        _, _, _, row, h, n_words = terms(column)
        held = [np.zeros(0, np.int64)]
        for h, row, (hashes, number) in ((h[:n_words], row[:n_words], (self.hashes, self.number)), (h[n_words:], row[n_words:], self.tables)):
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                known = hashes[at] == h
                held.append(row[known] * len(self.hashes) + number[at[known]])
        return np.unique(np.concatenate(held), return_counts=True)

    def vectors(self, column: pa.Array) -> list[np.ndarray]:
        """Term numbers with their counts in each text."""
        pair, n = self.pairs(column)
        at = np.searchsorted(pair, np.arange(len(column) + 1) * len(self.hashes)) if len(pair) else np.zeros(len(column) + 1, np.int64)
        both = np.stack([pair % max(1, len(self.hashes)), n], 1)
        return [both[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def document_frequencies(docs: DataFrame, text_col: str, index: Index) -> np.ndarray:
    """Rows of ``docs`` that hold each term of an index."""
    shared, size = docs.sparkSession.sparkContext.broadcast(index), len(index.hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for part in sliced(batches, 0):
            n += np.bincount(shared.value.pairs(part.column(0))[0] % size, minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["at", "n"])

    out = np.zeros(size, np.int64)
    if size:
        found = docs.select(text_col).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Index | None:
    """Index over the sample and its calibration; None if one of the two labels is missing.

    What is fetched are the words of the examples with their document frequencies in ``docs`` and, for each example,
    its id, label and counts of its words: all bounded by the sample. Repeated documents of one id are examples of
    their own; empty texts are examples without a term.
    """
    share = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if len(share) < 2:
        return None
    chosen = store(sample_labelled(docs, labels, label, sample), "examples")
    counted = store(presences(chosen), "terms")
    words = vocabulary(chosen, counted=counted)
    plain = counted.where("word").select("h", "n").toArrow()
    at = np.lexsort((plain["h"].to_numpy(), -plain["n"].to_numpy()))
    plain = plain["h"].to_numpy()[at]
    plain = plain[~np.isin(plain, np.array([h for _, h, _ in words], np.int64))]
    frequent = plain[: max(0, FREQUENT - len(words))].tolist()
    tables = [*((t, h) for t, h, _ in words), *(("", h) for h in frequent)]
    rest = plain[len(frequent) :].view(np.uint64)
    empty = Index([(t, h, 1.0) for t, h in tables], [], np.zeros(0), [], (rest, np.ones(len(rest))))
    idf = np.log(docs.count() / np.maximum(document_frequencies(docs, "text", empty), 1)) + 0.1
    idf[len(words) :] *= PLAIN
    shared = docs.sparkSession.sparkContext.broadcast(empty)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 0):
            vectors = shared.value.vectors(part.column(0))
            yield pa.RecordBatch.from_arrays(
                [part.column(2), part.column(1), pa.array([v[:, 0] for v in vectors], pa.list_(pa.int32())),
                 pa.array([v[:, 1] for v in vectors], pa.list_(pa.int32()))],
                ["id", "y", "t", "n"],
            )

    kind = chosen.schema["id"].dataType.simpleString()
    rows = chosen.select("text", "y", "id").mapInArrow(measure, f"id {kind}, y int, t array<int>, n array<int>").orderBy("id", "t", "n", "y").toArrow()
    ids, y = rows["id"].to_pylist(), rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    vectors = [np.stack([t.values.to_numpy(), n.values.to_numpy()], 1) for t, n in zip(rows["t"], rows["n"], strict=True)]
    del rows
    index = Index([(t, h, x) for (t, h), x in zip(tables, idf.tolist(), strict=False)], ids, y, vectors, (rest, idf[len(tables) :]))
    # examples are drawn evenly from both labels: weights restore the shares of the labels
    sampled = np.bincount(index.labels.astype(int), minlength=2)
    weight = np.array([share[0], share[1]]) / np.maximum(sampled, 1)
    weight = weight / weight.min()
    some = np.array([len(vectors[j]) > 0 for j in index.place])
    y = index.labels.astype(int)
    none = np.bincount(y[~some], minlength=2) * weight
    x = np.array([vote for vote, _, _ in index.votes([vectors[j] for j in index.place[some]], np.flatnonzero(some))])[:, None]
    y, times = y[some], weight[y[some]]
    index.base = float((none[1] + 0.5) / (none.sum() + 1.0)) if none.sum() else float(share[1] / (share[0] + share[1]))
    if len(set(y.tolist())) == 2:
        times = np.maximum(1, np.round(times)).astype(int)
        centre, scale, w = fit_logistic(np.repeat(x, times, 0), np.repeat(y.astype(float), times))
        index.calibration = (w[0] / scale[0], w[1] - w[0] * centre[0] / scale[0])
    return index


def score(docs: DataFrame, index: Index | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with ``score``, ``predicted``, ``neighbours`` (ids) and ``cosines``.

    A null text counts as empty. Without an index every score is 0. Columns of the new names are replaced.
    Equal cosines go to the examples that stand first in the index (by leading term, then id). Neighbours are
    bigint where all ids of the examples are integers, else text. Repeated rows get the same result.
    """
    made = ("score", "predicted", "neighbours", "cosines")
    names = [c for c in docs.columns if c not in made]
    docs = docs.select(*names)
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    id_type = index.id_type if index else "bigint"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, as_id = shared.value, int if id_type == "bigint" else str
        for part in sliced(batches, at):
            if held is None:
                found = [(0.0, [], [])] * part.num_rows
            else:
                found = held.score(held.vectors(part.column(at)))
            value = np.array([s for s, _, _ in found])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32)),
                 pa.array([[as_id(i) for i in n] for _, n, _ in found], pa.list_(pa.int64() if id_type == "bigint" else pa.string())),
                 pa.array([c for _, _, c in found], pa.list_(pa.float64()))],
                [*names, *made],
            )

    new = StructType.fromDDL(f"score double, predicted int, neighbours array<{id_type}>, cosines array<double>")
    return docs.mapInArrow(apply, StructType([*docs.schema.fields, *new.fields]))
