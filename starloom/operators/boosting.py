"""Gradient boosting of trees on histograms: missing values have a bin of their own, leaves grow best first.

Rows are kept in blocks, one byte for each bin and the bins of a feature side by side; a pass over them adds up
gradients for each (leaf, feature, bin) in every task and then over the tasks, and the driver picks splits from these
sums, whose number does not depend on the rows. A pass follows only the rows that reach a wanted node, and splits
them as lists. Gradients are whole multiples of 2**-24, so sums are exact and trees do not depend on the partitioning.
"""

from __future__ import annotations

import heapq
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.trees import LEAF, Tree, TreeModel
from starloom.session import ensure_checkpoint_dir, importable

MAX_BINS = 255
MAX_LEAVES = 31
MISSING = 255
UNIT = float(1 << 24)
#: Second-order weight that both sides of a split must have.
MIN_HESSIAN = 1e-3
#: A pass over fewer rows than this is not worth a task of its own.
TASK_ROWS = 100_000
#: Rows of a block, fewer if they have many features.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 4 << 20
#: Trees whose sum each pass works out before the scores are written again.
PENDING = 8
BLOCK_COLUMNS = ["y", "w", "bins", "margin"]
BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in BLOCK_COLUMNS)


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: np.ndarray  # g, h, n of the left side
    right: np.ndarray


@dataclass
class Growing:
    """A tree of known splits: more than the final one may have, as children are looked at before they are needed."""

    sums: list[np.ndarray] = field(default_factory=list)  # g, h, n of a node
    depth: list[int] = field(default_factory=list)
    split: list[Split | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    hist: dict[int, np.ndarray] = field(default_factory=dict)  # of nodes whose children are not known yet

    def add(self, sums: np.ndarray, depth: int) -> int:
        self.sums.append(sums)
        self.depth.append(depth)
        self.split.append(None)
        self.left.append(LEAF)
        self.right.append(LEAF)
        return len(self.sums) - 1

    def routes(self) -> tuple[np.ndarray, ...]:
        inner = [s is not None and at != LEAF for s, at in zip(self.split, self.left, strict=True)]
        of = lambda get, none: np.array([get(s) if i else none for s, i in zip(self.split, inner, strict=True)])
        return (of(lambda s: s.feature, LEAF), of(lambda s: s.bin, 0), of(lambda s: s.missing_left, False),
                np.array(self.left), np.array(self.right))


def reached(routes: tuple[np.ndarray, ...], bins: np.ndarray, wanted: Collection[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes without children (or those of ``wanted``) that rows reach, each with its rows. ``bins`` has a line for each feature."""
    feature, at, missing_left, left, right = routes
    needed = feature == LEAF if wanted is None else np.isin(np.arange(len(feature)), list(wanted))
    needed = needed.copy()
    for node in range(len(feature) - 1, -1, -1):  # parents come before their children
        if feature[node] != LEAF:
            needed[node] |= needed[left[node]] or needed[right[node]]
    stack: list[tuple[int, np.ndarray]] = [(0, np.arange(bins.shape[1]))]
    while stack:
        node, rows = stack.pop()
        if not needed[node] or not len(rows):
            continue
        if feature[node] == LEAF:
            yield node, rows
            continue
        side = np.arange(MISSING + 1) <= at[node]
        side[MISSING] = missing_left[node]
        goes_left = side[bins[feature[node]][rows]]
        stack += [(int(right[node]), rows[~goes_left]), (int(left[node]), rows[goes_left])]


def bin_edges(values: DataFrame, width: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: its values at evenly spaced ranks, all in one aggregate.

    A feature of few values has a bin for each of them that holds at least one of ``max_bins`` of the rows.
    """
    ranks = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    x = F.col("x")
    known = [F.when(~F.isnan(x[j]), x[j]) for j in range(width)]
    row = values.agg(*[F.percentile_approx(k, ranks, F.lit(100_000)).alias(f"e{j}") for j, k in enumerate(known)]).first()
    return [np.unique(np.array(e or [], float)) for e in row]


def binned_rows(values: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of rows: y, w, margin as doubles and one byte for each feature, feature after feature."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, len(edges))))

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        y, w = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        bins = np.concatenate([h[2] for h in held], axis=1)
        columns = [y.tobytes(), w.tobytes(), bins.tobytes(), np.full(len(y), base).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], BLOCK_COLUMNS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                if held and size + batch.num_rows > most:
                    yield block(held)
                    held, size = [], 0
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
                bins = np.empty((len(edges), batch.num_rows), np.uint8)
                for j, e in enumerate(edges):
                    bins[j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], "left"))
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), bins))
                size += batch.num_rows
        if held:
            yield block(held)

    return values.mapInArrow(cut, BLOCK_SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """y, w, margin and the bins of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            y, w, bins, margin = (batch.column(c)[i].as_buffer() for c in BLOCK_COLUMNS)
            y, w, margin = (np.frombuffer(c, np.float64) for c in (y, w, margin))
            yield y, w, margin, np.frombuffer(bins, np.uint8).reshape(width, len(y))


def _margins(margin: np.ndarray, bins: np.ndarray, pending: list[tuple[tuple, np.ndarray]]) -> np.ndarray:
    margin = margin.copy()
    for routes, value in pending:
        for node, rows in reached(routes, bins):
            margin[rows] += value[node]
    return margin


def histograms(rows: DataFrame, width: int, pending: list, routes: tuple, wanted: list[int]) -> dict[int, np.ndarray]:
    """Sums of gradient, second derivative and rows by (feature, bin) of the wanted nodes, as whole numbers."""
    place = {node: i for i, node in enumerate(wanted)}
    size = 256 * len(wanted)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width, size))
        for y, w, margin, bins in _blocks(batches, width):
            parts = list(reached(routes, bins, wanted))
            if not parts:
                continue
            held = np.concatenate([r for _, r in parts])
            at = np.repeat([256 * place[n] for n, _ in parts], [len(r) for _, r in parts])
            y, w, bins = y[held], w[held], bins[:, held]
            p = 1.0 / (1.0 + np.exp(-_margins(margin[held], bins, pending)))
            g, h = np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)
            for j in range(width):
                slot = at + bins[j]
                for k, v in enumerate((g, h, None)):
                    total[k, j] += np.bincount(slot, v, size)
        total = total.reshape(3, -1)
        held = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held)] + [pa.array(t[held].astype(np.int64)) for t in total], ["slot", "g", "h", "n"]
        )

    summed = rows.mapInArrow(add, "slot long, g long, h long, n long").groupBy("slot").agg(*[F.sum(c).alias(c) for c in "ghn"])
    got = summed.toArrow()
    out = np.zeros((3, width * size), np.int64)
    for k, c in enumerate("ghn"):
        out[k, got["slot"].to_numpy()] = got[c].to_numpy()
    out = out.reshape(3, width, len(wanted), 256).transpose(2, 1, 3, 0)
    return {node: out[i] for i, node in enumerate(wanted)}


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / np.maximum(h, 1e-12)


def best_split(hist: np.ndarray, min_leaf: int) -> Split | None:
    """The split of most gain; of equal ones (to 12 digits) the first by feature, bin, and missing rows on the right."""
    sums = hist / np.array([UNIT, UNIT, 1.0])
    whole = sums[0].sum(axis=0)
    parts = []
    for missing_left in (False, True):
        left = sums[:, :MISSING].cumsum(axis=1)
        if missing_left:
            left = left + sums[:, MISSING:]
        right = whole - left
        ok = (left[..., 2] >= min_leaf) & (right[..., 2] >= min_leaf)
        ok &= (left[..., 1] >= MIN_HESSIAN) & (right[..., 1] >= MIN_HESSIAN)
        gain = _gain(left[..., 0], left[..., 1]) + _gain(right[..., 0], right[..., 1]) - _gain(whole[0], whole[1])
        parts.append(np.where(ok, gain, -np.inf))
    gains = np.stack(parts, axis=-1)
    top = gains.max()
    if not np.isfinite(top) or top <= 1e-9:
        return None
    f, b, side = (int(i) for i in np.argwhere(gains >= top - abs(top) * 1e-12)[0])
    left = hist[f, : b + 1].sum(axis=0) + (hist[f, MISSING] if side else 0)
    right = hist[f].sum(axis=0) - left
    # without missing rows in training, later ones follow the larger side
    missing_left = bool(side) if hist[f, MISSING, 2] else bool(left[2] >= right[2])
    return Split(float(top), f, b, missing_left, left, right)


def grow(rows: DataFrame, width: int, pending: list, max_depth: int | None, min_leaf: int, max_leaves: int) -> tuple[Growing, set[int]]:
    """A tree, and the nodes that are split in it.

    Leaves are split in the order of their gain. A pass works out the children of all leaves that may come next, so there
    are about as many passes as levels and not as splits.
    """
    tree = Growing()
    root = histograms(rows, width, pending, (np.array([LEAF]),) + (np.zeros(1, np.int64),) * 4, [0])[0]
    tree.add(root[0].sum(axis=0), 0)

    def settle(node: int, hist: np.ndarray) -> None:
        if max_depth is None or tree.depth[node] < max_depth:
            tree.split[node] = best_split(hist, min_leaf)
            tree.hist[node] = hist

    settle(0, root)
    while True:
        heap, done = [(-tree.split[0].gain, 0)] if tree.split[0] else [], set()
        while heap and len(done) < max_leaves - 1 and tree.left[heap[0][1]] != LEAF:
            node = heapq.heappop(heap)[1]
            done.add(node)
            for child in (tree.left[node], tree.right[node]):
                if tree.split[child]:
                    heapq.heappush(heap, (-tree.split[child].gain, child))
        if not heap or len(done) == max_leaves - 1:
            return tree, done
        ahead = [n for _, n in sorted(heap) if tree.left[n] == LEAF][: max_leaves - 1 - len(done)]
        wanted = {}
        for node in ahead:
            split = tree.split[node]
            tree.left[node], tree.right[node] = (tree.add(s, tree.depth[node] + 1) for s in (split.left, split.right))
            small = tree.left[node] if split.left[2] <= split.right[2] else tree.right[node]
            wanted[small] = node
        found = histograms(rows, width, pending, tree.routes(), list(wanted))
        for small, node in wanted.items():
            other = tree.right[node] if small == tree.left[node] else tree.left[node]
            rest = tree.hist.pop(node) - found[small]  # whole numbers: exact
            settle(small, found[small])
            settle(other, rest)


def finished(tree: Growing, done: set[int], edges: list[np.ndarray], rate: float) -> tuple[Tree, tuple]:
    """The node table of the final tree, and how bins go through it."""
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order.append(node)
        if node in done:
            stack += [tree.right[node], tree.left[node]]
    number = {old: new for new, old in enumerate(order)}
    inner = [n in done for n in order]
    of = lambda get, none: [get(n) if i else none for n, i in zip(order, inner, strict=True)]
    sums = np.array([tree.sums[n] for n in order]) / np.array([UNIT, UNIT, 1.0])

    def edge(n: int) -> float:  # beyond the last edge all values that are there go left
        e = edges[tree.split[n].feature]
        return float(e[tree.split[n].bin]) if tree.split[n].bin < len(e) else np.inf

    table = Tree.of({
        "feature": of(lambda n: tree.split[n].feature, LEAF), "threshold": of(edge, 0.0),
        "missing_left": of(lambda n: tree.split[n].missing_left, False),
        "left": of(lambda n: number[tree.left[n]], LEAF), "right": of(lambda n: number[tree.right[n]], LEAF),
        "value": -rate * sums[:, 0] / np.maximum(sums[:, 1], 1e-12), "cover": sums[:, 2], "risk": np.zeros(len(order)),
    })
    bins = np.array(of(lambda n: tree.split[n].bin, 0))
    return table, (table.feature, bins, table.missing_left, table.left, table.right)


class HistogramBoosting(Estimator):
    """Boosted trees for a 0/1 label under logistic loss, with a weight for each row and missing values as they are."""

    def __init__(self, max_iter: int = 100, max_depth: int | None = None, learning_rate: float = 0.1, min_samples_leaf: int = 20,
                 max_leaves: int = MAX_LEAVES, label: str = "label", weight: str = "weight", vector: str = "features") -> None:
        super().__init__()
        self.max_iter, self.max_depth, self.learning_rate = max_iter, max_depth, learning_rate
        self.min_samples_leaf, self.max_leaves = min_samples_leaf, max_leaves
        self.label, self.weight, self.vector = label, weight, vector

    def _fit(self, dataset: DataFrame) -> TreeModel:
        importable(dataset.sparkSession)
        ensure_checkpoint_dir(dataset.sparkSession)
        x = vector_to_array(self.vector)
        values = dataset.select(F.col(self.label).cast("double").alias("y"), F.col(self.weight).cast("double").alias("w"), x.alias("x"))
        sums = values.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.max(F.size("x")), F.count("*"))
        total, positive, width, n = sums.first()
        if not total:
            raise ValueError("no rows to fit")
        share = positive / total
        if not 0 < share < 1:  # one class only: its share is all there is to learn
            return TreeModel.of([], share, "mean")
        base = float(np.log(share / (1 - share)))
        edges = bin_edges(values, width)
        rows = binned_rows(values, edges, base).coalesce(-(-n // TASK_ROWS)).checkpoint()
        trees: list[Tree] = []
        pending: list = []
        for _ in range(self.max_iter):
            tree, done = grow(rows, width, pending, self.max_depth, self.min_samples_leaf, self.max_leaves)
            if not done:
                break
            table, routes = finished(tree, done, edges, self.learning_rate)
            trees.append(table)
            pending.append((routes, table.value))
            if len(pending) == PENDING:
                rows = _with_margins(rows, width, pending).checkpoint()
                pending = []
        return TreeModel.of(trees, base, "logit")


def _with_margins(rows: DataFrame, width: int, pending: list) -> DataFrame:
    pending = list(pending)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("margin")
            sums = [_margins(margin, bins, pending).tobytes() for _, _, margin, bins in _blocks(iter([batch]), width)]
            yield batch.set_column(at, "margin", pa.array(sums, pa.binary()))

    return rows.mapInArrow(add, BLOCK_SCHEMA)
