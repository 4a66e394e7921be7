"""Exact top-k by the threshold algorithm over sorted lists, one for each dimension.

Candidates fall into blocks; a block keeps for each dimension the list of its vectors sorted by that component. A
query reads the lists from the end that favours it, from all dimensions to the same depth, and scores every vector
that it meets for the first time. No vector that it has not met can score more than the query's product with the
components at this depth; as soon as that bound is below the k-th best score, the rest of the block is not read.

The queries go in batches through all blocks. The queries of a batch read the lists of a block together: what any of them meets
is scored for all that are not done, in one matrix product. Each batch first searches one block, whose k-th score is where the
search of all others begins. Blocks are dealt to tasks; a task gets a copy of the batches, holds them and lets its blocks
pass by, so batches are copied once a task and not once a block, and only through the shuffle, never the driver. The k best of
its blocks leave the task, and their k-th score is where the search of its next block begins. Equal query
vectors are searched once, and of equal candidates only the k + 1 least ids are kept, which is all that any result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.batches import partitions, store

K = 5
SCALE = 256
BLOCK = 2_048
BATCH = 512
#: Depth of the first step; every further one is twice as deep.
FIRST_DEPTH = 32
#: Batches that a task holds on average at most, or fewer for a larger k; if there are more, blocks are copied too.
HELD = 512
#: Batches are copied to no more tasks than these for each core, however many partitions other shuffles have.
TASKS_A_CORE = 8
#: Results of a query vector are dealt to this many keys where the queries fetch them: one vector may ask very often.
SALTS = 16

NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v: floor(scale * x) of every vector that is not null and holds finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * float(scale)).cast("long"))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.when(finite, whole).alias("v"))
    return kept.where(F.col("id").isNotNull() & F.col("v").isNotNull())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length as a matrix of the smallest of three integer types."""
    whole = column.flatten().to_numpy().reshape(len(column), dim)
    least, most = whole.min(initial=0), whole.max(initial=0)
    return whole.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _unpacked(data: bytes, n: int, dim: int, kind: str = "i") -> np.ndarray:
    """The matrix of these bytes; their number tells the size of a component."""
    return np.frombuffer(data, f"{kind}{len(data) // (n * dim) if n * dim else 8}").reshape(n, dim)


def candidate_blocks(vectors: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks of candidates: dim, block, n, ids, v, and lists, the rows of the block in the order of each component."""

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        table = table.sort_by("id").combine_chunks()
        v = _matrix(table["v"].combine_chunks(), dim)
        lists = np.argsort(v, axis=0, kind="stable").T.astype(np.uint16 if len(v) <= 1 << 16 else np.uint32)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int32()),
            "n": pa.array([len(v)], pa.int32()), "ids": [table["id"].to_numpy().tobytes()], "v": [v.tobytes()],
            "lists": [np.ascontiguousarray(lists).tobytes()],
        })

    block = F.pmod(F.xxhash64("v", "id"), F.lit(n_blocks)).cast("int")
    rows = vectors.select(F.size("v").alias("dim"), block.alias("block"), "id", "v")
    return rows.groupBy("dim", "block").applyInArrow(build, "dim int, block int, n int, ids binary, v binary, lists binary")


def query_batches(queries: DataFrame, n_batches: int) -> DataFrame:
    """Batches of distinct query vectors: dim, batch, n, keys, v."""

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        v = _matrix(table["v"].combine_chunks(), dim)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "batch": pa.array([table["batch"][0].as_py()], pa.int32()),
            "n": pa.array([len(v)], pa.int32()), "keys": [table["key"].to_numpy().tobytes()], "v": [v.tobytes()],
        })

    batch = F.pmod(F.xxhash64("v"), F.lit(n_batches)).cast("int")
    rows = queries.select(F.size("v").alias("dim"), batch.alias("batch"), "key", "v")
    return rows.groupBy("dim", "batch").applyInArrow(build, "dim int, batch int, n int, keys binary, v binary")


def _working(v: np.ndarray, q: np.ndarray) -> type:
    """A number type in which products of these vectors are exact."""
    reach = int(np.abs(v.astype(np.float64)).max(initial=0)) * int(np.abs(q.astype(np.float64)).max(initial=0)) * max(v.shape[1], 1)
    return next((t for t, top in ((np.float32, 1 << 24), (np.float64, 1 << 52), (np.int64, 1 << 62)) if reach < top), object)


def _long(scores: np.ndarray) -> np.ndarray:
    """Python's integers beyond 64 bits as the largest or least long; other numbers as they are."""
    return np.minimum(np.maximum(scores, NONE), -NONE - 1) if scores.dtype == object else scores


def _best(of: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the k best of each query, the smaller row of equal scores; then queries that have k, and their k-th scores."""
    order = np.lexsort((rows, ~scores if scores.dtype == np.int64 else -scores, of))
    begins = np.flatnonzero(np.diff(of[order], prepend=-1))
    place = np.arange(len(of)) - np.repeat(begins, np.diff(begins, append=len(of)))
    last = order[place == k - 1]
    return order[place < k], of[last], scores[last]


def batch_search(
    v: np.ndarray, values: np.ndarray, lists: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query, row and score of rows that may be among the k best of each query, and how many vectors were scored.

    ``values`` are the components in the order of ``lists``. Rows that score less than a query's floor are of no use to it. Among
    equal scores the smaller row number is better.
    """
    n = len(v)
    up, down, floors = np.maximum(q, 0), np.minimum(q, 0), floors.astype(v.dtype)
    left, todo = np.ones(n, bool), np.arange(len(q))
    of, rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, v.dtype)
    depth, scored = 0, 0
    while True:
        depth = min(n, FIRST_DEPTH if not depth else 2 * depth)
        met = np.full(n, depth == n)
        met[lists[(up[todo] > 0).any(axis=0), n - depth :].ravel()] = True
        met[lists[(down[todo] < 0).any(axis=0), :depth].ravel()] = True
        new = np.flatnonzero(met & left)
        left[new] = False
        scored += len(new)
        more = _long(q[todo] @ v[new].T)
        hits = np.flatnonzero(more >= floors[todo, None])
        many = np.bincount(hits // max(1, len(new)), minlength=len(todo)) > 4 * k
        if many.any() and more.dtype != object:  # k of them reach the k-th, so no others need to be sorted
            least = np.partition(more[many], len(new) - k, axis=1)[:, len(new) - k]
            floors[todo[many]] = np.maximum(floors[todo[many]], least)
            hits = np.flatnonzero(more >= floors[todo, None])
        at, j = np.divmod(hits, max(1, len(new)))
        of, rows, scores = np.concatenate([of, todo[at]]), np.concatenate([rows, new[j]]), np.concatenate([scores, more[at, j]])
        best, full, least = _best(of, rows, scores, k)
        of, rows, scores = of[best], rows[best], scores[best]
        floors[full] = np.maximum(floors[full], least)
        if depth == n or scored == n:
            return of, rows, scores, scored
        bound = up[todo] @ values[:, n - depth - 1] + down[todo] @ values[:, depth]
        todo = todo[_long(bound) >= floors[todo]]
        if not len(todo):
            return of, rows, scores, scored


def threshold_search(
    v: np.ndarray, values: np.ndarray, lists: np.ndarray, q: np.ndarray, k: int, floor: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """``batch_search`` for one query."""
    return batch_search(v, values, lists, q[None], k, np.array([floor]))[1:]


class _Block:
    """A block of candidates, unpacked once for all batches that it meets."""

    def __init__(self, row: dict) -> None:
        self.dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.v = _unpacked(row["v"], row["n"], row["dim"])
        self.lists = _unpacked(row["more"], row["dim"], row["n"], "u")
        self.kinds: dict = {}

    def found(self, q: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query, id, score and whether the vector is the query's own, of what may be among the k best of each query."""
        kind = _working(self.v, q)
        if kind not in self.kinds:
            v = self.v.astype(kind)
            self.kinds[kind] = v, np.take_along_axis(v.T, self.lists.astype(np.int64), axis=1)
        of, rows, scores, _ = batch_search(*self.kinds[kind], self.lists, q.astype(kind), k, floors)
        return of, self.ids[rows], scores.astype(np.int64), (self.v[rows] == q[of]).all(axis=1)


class _Held:
    """A batch of queries and the best that they have found so far."""

    def __init__(self, row: dict) -> None:
        self.dim = row["dim"]
        self.keys, self.floors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["more"], np.int64).copy()
        self.q = _unpacked(row["v"], row["n"], row["dim"])
        self.hits = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def meet(self, block: _Block, k: int) -> None:
        found = block.found(self.q, k, self.floors)
        if len(found[0]):
            hits = [np.concatenate(pair) for pair in zip(self.hits, found, strict=True)]
            best, full, least = _best(*hits[:3], k)
            self.hits = tuple(x[best] for x in hits)
            self.floors[full] = np.maximum(self.floors[full], least)

    def result(self) -> pa.RecordBatch:
        of, *rest = self.hits
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.keys[of], *rest)], ["key", "id", "score", "same"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in batches:
        for i in range(part.num_rows):
            row = {name: part.column(j)[i] for j, name in enumerate(part.schema.names)}
            yield {k: x.as_buffer() if isinstance(x, pa.BinaryScalar) else x.as_py() for k, x in row.items()}


def _together(batches: DataFrame, blocks: DataFrame, n_tasks: int, blocks_first: bool) -> DataFrame:
    """Batches and blocks in the tasks that they name, those of one dimension after each other."""
    shared = ["task", "dim", "n"]
    blocks = blocks.select(*shared, F.lit(True).alias("is_block"), F.col("block").alias("number"), "ids", "v", F.col("lists").alias("more"))
    batches = batches.select(*shared, F.lit(False).alias("is_block"), F.col("batch").alias("number"), F.col("keys").alias("ids"), "v", F.col("floors").alias("more"))
    side = F.col("is_block").desc() if blocks_first else F.col("is_block")
    return batches.union(blocks).repartitionById(n_tasks, F.col("task")).sortWithinPartitions("dim", side, "number")


def _copies(rows: DataFrame, n: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def search(batches: DataFrame, blocks: DataFrame, n_blocks: int, n_batches: int, k: int) -> DataFrame:
    """key, id, score and same (the query's own vector) of the ``k`` best of each task, among which are the ``k`` best of all.

    Every batch first meets one block, whose k-th scores go with it. Then blocks are dealt to lanes and batches to groups
    (one, unless they are too many to hold or blocks too few for all tasks), and each pair of them is a task.
    """
    spark = batches.sparkSession
    n_tasks = min(partitions(spark), TASKS_A_CORE * spark.sparkContext.defaultParallelism)

    def prime(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for row in _rows(rows):
            if row["is_block"]:
                block = _Block(row)
                continue
            batch = _Held(row | {"more": np.full(row["n"], NONE)})
            if block is not None and block.dim == row["dim"]:  # a block may have no vector of this dimension
                batch.meet(block, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["dim"]], pa.int32()), pa.array([row["number"]], pa.int32()), pa.array([row["n"]], pa.int32()),
                 pa.array([batch.keys.tobytes()]), pa.array([batch.q.tobytes()]), pa.array([batch.floors.tobytes()])],
                ["dim", "batch", "n", "keys", "v", "floors"],
            )

    def probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Held] = []
        for row in _rows(rows):
            if held and held[0].dim != row["dim"]:
                yield from (batch.result() for batch in held)
                held = []
            if not row["is_block"]:
                held.append(_Held(row))
            elif held:
                block = _Block(row)
                for batch in held:
                    batch.meet(block, k)
        yield from (batch.result() for batch in held)

    lanes = min(n_blocks, n_batches)
    parts = min(-(-n_batches // lanes), -(-n_tasks // lanes))
    first = batches.withColumn("task", F.col("batch") % lanes * parts + F.floor(F.col("batch") / lanes).cast("int") % parts)
    met = _copies(blocks.where(F.col("block") < lanes), parts, "part").withColumn("task", F.col("block") * parts + F.col("part"))
    met = _together(first.withColumn("floors", F.lit(b"")), met, lanes * parts, True)
    ready = store(met.mapInArrow(prime, "dim int, batch int, n int, keys binary, v binary, floors binary"), "batches")

    groups = min(n_batches, max(-(-n_batches // max(1, HELD * (K + 1) // k)), -(-n_tasks // n_blocks)))
    lanes = min(n_blocks, -(-n_tasks // groups))
    dealt = _copies(ready, lanes, "lane").withColumn("task", F.col("lane") * groups + F.col("batch") % groups)
    met = _copies(blocks, groups, "group").withColumn("task", F.col("block") % lanes * groups + F.col("group"))
    return _together(dealt, met, lanes * groups, False).mapInArrow(probe, "key long, id long, score long, same boolean")


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id",
    vector_col: str = "embedding", block: int = BLOCK, batch: int = BATCH,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best other rows of every query row (all, if there are fewer).

    The score is the product of the vectors whose components are floor(scale * x); it is exact (beyond 64 bits it is
    the largest or least long; so are components). Ties go to the smaller id. A query's own row is no candidate of it:
    the row of ``candidates`` with its id and its vector, once. Repeated rows are candidates each, and a repeated query
    row has its results repeated. Vectors that are null or hold null, NaN or infinite components and rows without an id take no
    part; vectors of different lengths don't meet; empty vectors score 0. Empty tables give an empty result. Other columns are
    not read.
    """
    asked = store(whole_vectors(queries, scale, id_col, vector_col).withColumn("key", F.xxhash64("v")), "queries")
    least = Window.partitionBy("v").orderBy("id")
    kept = whole_vectors(candidates, scale, id_col, vector_col).withColumn("copy", F.row_number().over(least))
    kept = store(kept.where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    distinct = store(asked.groupBy("key", "v").agg(F.lit(1).alias("one")).drop("one"), "query_vectors")
    n_blocks, n_batches = (max(1, -(-t.count() // n)) for t, n in ((kept, block), (distinct, batch)))
    blocks = store(candidate_blocks(kept, n_blocks), "blocks")
    found = search(query_batches(distinct, n_batches), blocks, n_blocks, n_batches, k + 1)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    best = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "same"))).alias("best"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.select(F.col("id").alias("query_id"), "key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    mine = F.filter("best", lambda b: (b["id"] == F.col("query_id")) & b["same"])
    taken = F.coalesce(F.get(mine, F.lit(0))["place"], F.lit(k + 2))
    others = F.slice(F.filter("best", lambda b: b["place"] != taken), 1, k)
    rows = asked.join(best, ["key", "salt"]).select("query_id", F.posexplode(others).alias("at", "hit"))
    return rows.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score")
    )
