"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Components become integers, floor(256 * x). Candidates are packed into blocks of BLOCK vectors; a block has one list for each
dimension, sorted by component. A block of queries reads the lists in step, each list in the direction of its falling
contributions. What was read of a vector is added up; a lower bound puts the list's end in place of what was not read, an upper
bound the value at the reading head. Both bounds of all open queries are one matrix product each. A query stops reading when so
few vectors are left whose upper bound reaches its k-th best score or lower bound that these alone get their final scores.

Every query starts from a bound that holds for all blocks: its k-th best score in one block of candidates. Queries are
broadcast where they have at most BROADCAST_BYTES; otherwise groups of query blocks meet groups of candidate blocks in a shuffle,
so that no key holds more than GROUP blocks of either side. Each task hands on k rows for each query.

Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of other dimensions than the
query's are no candidates. Rows with the query's own id are not either. Repeated rows count as often as they are there. Scores
must stay below 2**63 in size. Ties go to the smaller id. A query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrylake.llm.common import staged

BLOCK, QUERY_BLOCK = 2048, 1024
#: Queries are broadcast up to this size.
BROADCAST_BYTES = 64 << 20
#: Beyond it, so many query blocks meet so many candidate blocks under one key.
GROUP = 32
#: A query stops reading when so few vectors of a block can still qualify.
FEW = 64
#: The lists of a block are read in so many steps.
STEPS = 4

PACKED = "dim int, n int, ids binary, vectors binary"


def quantised(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, dim and integer components of the vectors that take part."""
    good = F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(good & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.size(column).alias("dim"), F.transform(column, lambda x: F.floor(x.cast("double") * 256)).alias("v")
    )


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows of at most `block` vectors each, packed where they are read: no shuffle, so repeated ids don't gather anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if len(ids) > block:
                held[dim] = [(ids[block:], v[block:])]
            row = (dim, min(block, len(ids)), ids[:block].tobytes(), v[:block].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dim", "n", "ids", "vectors"])

        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                held.setdefault(dim, []).append((some.column(0).to_numpy(), some.column(2).flatten().to_numpy().reshape(-1, dim)))
                while sum(len(p[0]) for p in held.get(dim, [])) >= block:
                    yield out(dim)
        for dim in list(held):
            while dim in held:
                yield out(dim)

    return rows.select("id", "dim", "v").mapInArrow(run, PACKED)


class Queries:
    """A block of queries with the k best candidates found so far, and a bound that the k-th best of all reaches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.bound = bound.astype(np.float64)
        self.found = [np.zeros(0, np.int64)] * 3  # query's place, id, score

    def add(self, place: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keeps the k best of each query."""
        place, ids, score = (np.concatenate(x) for x in zip(self.found, (place, ids, score), strict=True))
        order = np.lexsort((ids, -score, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        keep = rank < self.k
        order = order[keep]
        self.found = [place[keep], ids[order], score[order]]
        last = rank[keep] == self.k - 1
        at = self.found[0][last]
        self.bound[at] = np.maximum(self.bound[at], self.found[2][last])


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.sorted = np.sort(vectors, axis=0)  # a list for each dimension, rising
        self.by_id = np.argsort(ids, kind="stable")
        self.first = 0  # the step at which most queries stopped before

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of candidates with a query's own id, and of that query."""
        low, high = (np.searchsorted(self.ids, ids, side, sorter=self.by_id) for side in ("left", "right"))
        n = high - low
        place = np.repeat(np.arange(len(ids)), n)
        return self.by_id[np.repeat(low, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)], place

    def meet(self, asked: Queries) -> None:
        """Hands the queries this block's candidates that may be among their best."""
        n = len(self.ids)
        most = np.abs(self.vectors).max(0).astype(np.float64) @ np.abs(asked.vectors).max(0).astype(np.float64)
        kind = np.float32 if most < 1 << 24 else np.float64  # sums of such integers are exact
        slack = 0.0 if most < 1 << 53 else most * 1e-12
        up, down = (np.maximum(asked.vectors, 0).T.astype(kind), np.minimum(asked.vectors, 0).T.astype(kind))
        both = np.vstack([up, down])  # rising lists are read from their end where the query is positive
        v = self.vectors.astype(kind)
        own_row, own_place = self._own(asked.ids)
        alive = np.arange(len(asked.ids))  # queries that still read
        for step in range(self.first, STEPS):
            depth = -(-n * (step + 1) // STEPS)
            top, low = self.sorted[n - depth].astype(kind), self.sorted[depth - 1].astype(kind)
            upper = np.hstack([np.maximum(v, top), np.minimum(v, low)]) @ both[:, alive]
            ends = self.sorted[0].astype(kind), self.sorted[-1].astype(kind)
            lower = np.hstack([np.where(v >= top, v, ends[0]), np.where(v <= low, v, ends[1])]) @ both[:, alive]
            mine = np.full(len(asked.ids), -1)
            mine[alive] = np.arange(len(alive))
            some = mine[own_place] >= 0
            upper[own_row[some], mine[own_place[some]]] = lower[own_row[some], mine[own_place[some]]] = -np.inf
            bound = asked.bound[alive]
            if n >= asked.k:
                bound = np.maximum(bound, np.partition(lower, n - asked.k, axis=0)[n - asked.k])
            able = (upper >= bound - slack) & (upper > -np.inf)
            left = able.sum(0)
            stop = (left <= max(FEW, asked.k)) | (step == STEPS - 1)
            if stop.any():
                row, column = np.nonzero(able[:, stop])
                place = alive[stop][column]
                score = np.einsum("ij,ij->i", self.vectors[row], asked.vectors[place])
                asked.add(place, self.ids[row], score)
                if 2 * (len(alive) - stop.sum()) <= len(asked.ids) < 2 * len(alive):
                    self.first = step
            alive = alive[~stop]
            if not len(alive):
                break


def _blocks(batch: pa.RecordBatch, i: int, columns: tuple[int, ...], dim: int) -> list[np.ndarray]:
    ids, vectors = (np.frombuffer(batch.column(j)[i].as_buffer(), np.int64) for j in columns)
    return [ids, vectors.reshape(-1, dim)]


def _with_bounds(asked: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """The query blocks, each with the k-th best score of its queries among one block of candidates."""
    one = packed.groupBy("dim").agg(F.max_by(F.struct("ids", "vectors"), "n").alias("c")).select("dim", "c.ids", "c.vectors")
    met = asked.select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")).join(one, "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                ids, vectors = _blocks(batch, i, (1, 2), dim)
                known = Queries(ids, vectors, np.full(len(ids), -np.inf), k)
                Lists(*_blocks(batch, i, (3, 4), dim)).meet(known)
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(3)), pa.array([known.bound.tobytes()])], names=["dim", "query_ids", "query_vectors", "bounds"])

    return met.select("dim", "query_ids", "query_vectors", "ids", "vectors").mapInArrow(run, "dim int, query_ids binary, query_vectors binary, bounds binary")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, or all if fewer."""
    packed = staged(_packed(quantised(candidates, id_column, column), BLOCK), "lists")
    asked = staged(_with_bounds(staged(_packed(quantised(queries, id_column, column), QUERY_BLOCK), "queries"), packed, k), "bounds")
    n_blocks = packed.count()
    n_asked, size = asked.agg(F.count("*"), F.sum(F.length("query_ids") + F.length("query_vectors") + F.length("bounds"))).first()
    tasks = max(1, min(n_blocks, 4 * packed.sparkSession.sparkContext.defaultParallelism, n_blocks * max(1, n_asked)))
    if (size or 0) <= BROADCAST_BYTES:
        met = packed.repartition(max(tasks, n_blocks // GROUP)).join(F.broadcast(asked), "dim")
    else:
        left, right = -(-n_blocks // GROUP), -(-n_asked // GROUP)
        place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        met = packed.withColumn("a", place("ids", left)).withColumn("b", every(right)).join(asked.withColumn("b", place("query_ids", right)).withColumn("a", every(left)), ["dim", "a", "b"])
    met = met.select("dim", "ids", "vectors", "query_ids", "query_vectors", "bounds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], Queries] = {}
        last, lists = None, None

        def out() -> Iterator[pa.RecordBatch]:
            for asked in known.values():
                place, ids, score = asked.found
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[place]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])
            known.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                block = _blocks(batch, i, (1, 2), dim)
                if last is None or last[0] != dim or not np.array_equal(last[1], block[0]):
                    lists, last = Lists(*block), (dim, block[0])
                key = (dim, batch.column(3)[i].as_py())
                if key not in known:
                    if len(known) >= 2 * GROUP:  # what a task remembers stays small
                        yield from out()
                    known[key] = Queries(*_blocks(batch, i, (3, 4), dim), np.frombuffer(batch.column(5)[i].as_buffer()), k)
                lists.meet(known[key])
        yield from out()

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
