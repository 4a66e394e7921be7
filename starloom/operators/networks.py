"""Training of a feed-forward network on blocks of rows: limited-memory BFGS over one pass for each evaluation.

The objective is that of Spark's multilayer perceptron (sigmoid layers, softmax with cross-entropy on top) and the
weights are in its layout, so a fitted network is a model of Spark ML. A row has a number of copies, which multiplies
its loss; it is worked on once. Tasks add up loss and gradient over their blocks by matrix products; the driver gets
one vector as long as the weights from every task, adds them in the order of the tasks, and picks the next weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import importable

#: Rows of a block, and of the matrices that a task works on at a time.
BLOCK_ROWS, STEP_ROWS = 1 << 15, 1 << 10
#: Fewer rows than this are not worth a task of their own; more rows than all tasks hold make them larger.
TASK_ROWS, MAX_TASKS = 100_000, 1024
#: Earlier steps that the search direction remembers, tolerance, and values that convergence looks back on.
MEMORY, TOLERANCE, LOOK_BACK = 10, 1e-6, 20
#: Line search: trials, sufficient decrease and curvature.
TRIALS, DECREASE, CURVATURE = 10, 1e-4, 0.9

Evaluate = Callable[[np.ndarray], tuple[float, np.ndarray]]


def blocks_of(vectors: DataFrame, label: str, vector: str, copies: str) -> DataFrame:
    """Blocks of rows: labels, copies and features, row after row, as doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]).tobytes() for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["y", "c", "x"])

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                if held and size + batch.num_rows > BLOCK_ROWS:
                    yield block()
                    held, size = [], 0
                held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy()])
                size += batch.num_rows
        if held:
            yield block()

    rows = vectors.select(F.col(label).cast("double"), F.col(copies).cast("double"), vector_to_array(vector))
    return rows.mapInArrow(pack, "y binary, c binary, x binary")


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(weights: np.ndarray, sizes: Sequence[int], y: np.ndarray, c: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows, each times its copies."""
    layers = _layers(weights, sizes)
    outputs = [x]
    for w, b in layers[:-1]:
        z = outputs[-1] @ -w
        z -= b
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1.0
        outputs.append(np.reciprocal(z, out=z))
    z = outputs[-1] @ layers[-1][0] + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1)
    rows, at = np.arange(len(y)), y.astype(np.int64)
    loss = float((c * (np.log(total) - z[rows, at])).sum())
    delta = e / total[:, None]
    delta[rows, at] -= 1.0
    delta *= c[:, None]
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts += [delta.sum(axis=0), (outputs[i].T @ delta).ravel()]
        if i:
            back = delta @ layers[i][0].T
            back *= outputs[i]
            back *= np.subtract(1.0, outputs[i], out=outputs[i])  # not needed any more
            delta = back
    return loss, np.concatenate(parts[::-1])


def objective(blocks: DataFrame, sizes: Sequence[int]) -> Evaluate:
    """Mean loss over all copies, and its gradient, by one job; none for the weights of the last call, as a resumed fit starts there."""
    sizes = list(sizes)
    last: list[tuple[np.ndarray, tuple[float, np.ndarray]]] = []

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        if last and np.array_equal(last[0][0], weights):
            return last[0][1]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, n, gradient = 0.0, 0.0, np.zeros(len(weights))
            for batch in batches:
                for i in range(batch.num_rows):
                    y, c, x = (np.frombuffer(batch.column(j)[i].as_buffer()) for j in range(3))
                    x = x.reshape(len(y), sizes[0])
                    for start in range(0, len(y), STEP_ROWS):
                        cut = slice(start, start + STEP_ROWS)
                        part, slope = loss_and_gradient(weights, sizes, y[cut], c[cut], x[cut])
                        loss += part
                        gradient += slope
                    n += c.sum()
            if n:
                columns = [pa.array([v]) for v in (TaskContext.get().partitionId(), loss, n, gradient.tobytes())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "loss", "n", "gradient"])

        tasks = sorted(blocks.mapInArrow(add, "part long, loss double, n double, gradient binary").collect())
        if not tasks:
            raise ValueError("no rows to fit")
        total = sum(t["n"] for t in tasks)
        found = sum(t["loss"] for t in tasks) / total, sum(np.frombuffer(bytes(t["gradient"])) for t in tasks) / total
        last[:] = [(weights.copy(), found)]
        return found

    importable(blocks.sparkSession)
    return evaluate


class SearchFailed(Exception):
    """No step along the direction is good enough."""


def _search(along: Callable[[float], tuple[float, float]], value: float, slope: float, t: float) -> float:
    """A step, tried from ``t`` on, that meets the strong Wolfe conditions, by cubic interpolation inside brackets (t, value, slope)."""
    if slope > 0:
        raise SearchFailed

    def between(low: tuple, high: tuple) -> float:
        (a, fa, da), (b, fb, db) = (low, high) if low[0] <= high[0] else (high, low)
        d1 = da + db - 3 * (fa - fb) / (a - b)
        inner = d1 * d1 - da * db
        d2 = math.sqrt(inner) if inner >= 0 else math.nan
        bottom = db - da + 2 * d2
        t = b - (b - a) * (db + d2 - d1) / bottom if bottom else math.nan
        return min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a)) if not math.isnan(t) else (a + b) / 2

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(TRIALS):
            t = between(low, high)
            now = (t, *along(t))
            if now[1] > value + DECREASE * t * slope or now[1] >= low[1]:
                high = now
            else:
                if abs(now[2]) <= CURVATURE * abs(slope):
                    return t
                if now[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = now
        raise SearchFailed

    low = (0.0, value, slope)
    for i in range(TRIALS):
        now = (t, *along(t))
        if not math.isfinite(now[1]):
            t /= 2.0
            continue
        if now[1] > value + DECREASE * t * slope or (now[1] >= low[1] and i):
            return zoom(low, now)
        if abs(now[2]) <= CURVATURE * abs(slope):
            return t
        if now[2] >= 0:
            return zoom(now, low)
        low, t = now, t * 1.5
    raise SearchFailed


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out, shares = gradient.copy(), []
    for s, d in reversed(steps):
        shares.append(s @ out / (s @ d))
        out -= shares[-1] * d
    if steps:
        s, d = steps[-1]
        out *= s @ d / (d @ d)
    for (s, d), share in zip(steps, reversed(shares), strict=True):
        out += (share - d @ out / (s @ d)) * s
    return -out


def minimised(evaluate: Evaluate, weights: np.ndarray, iterations: int) -> np.ndarray:
    """Weights after at most this many steps of limited-memory BFGS; it ends early when the loss stands still."""
    value, gradient = evaluate(weights)
    first, values, steps, failed, done = value, [math.inf], [], False, 0
    while done < iterations:
        still = len(values) > 1 and abs(value - max(values)) <= TOLERANCE * first
        if still or np.linalg.norm(gradient) <= max(TOLERANCE * value, 1e-8):
            break
        direction = _direction(gradient, steps)
        seen: dict[float, tuple[float, np.ndarray]] = {}

        def along(t: float, at: np.ndarray = weights, to: np.ndarray = direction, seen: dict = seen) -> tuple[float, float]:
            seen.clear()
            seen[t] = evaluate(at + t * to)
            return seen[t][0], float(seen[t][1] @ to)

        try:
            t = _search(along, value, float(gradient @ direction), 1.0 if done else 1.0 / np.linalg.norm(direction))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed, steps = True, []
            continue
        failed, done = False, done + 1
        last, (value, new) = gradient, seen[t]
        weights, gradient = weights + t * direction, new
        steps = [*steps, (t * direction, new - last)][-MEMORY:]
        values = [*values, value][-LOOK_BACK:]
    return weights
