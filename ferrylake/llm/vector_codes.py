"""Product codes of vectors by Lloyd's rounds whose members stay with the owner of their codebook entry.

Each vector is cut into parts; a part is a member of one entry of its position's codebook. Members lie in partitions by
(position, entry, salt), and owners keep them: in a round an owner sums up its resident members for the next codebook,
assigns them again, and only members whose entry changes are sent to another owner. Spark's own shuffle does that: the
members that stay and the members that were sent share one partitioner, so their union moves nothing. This is the reason
why the rounds run on an RDD; reading, the final codes and their sums are DataFrames. Salts split entries with many
members, so that no owner grows with a hot entry. The driver sees codebooks only: `entries` integer vectors a position.

Components become floor(scale * x). All sums and distances are exact integers. Vectors that are null or hold null or
non-finite components are dropped. Vectors of other lengths count as filled up with zeros to the longest length, rounded up
to a multiple of `parts`. Integer components are held within 2**27, so that distances fit a long. Fewer vectors than entries
give a shorter codebook, none an empty result. The first entries come from the smallest ids, those of equal ids from the
smaller vector; null ids come last. Repeated rows are members as often as they are there. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.llm.common import exact, mix, skew_join, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
#: Members of one entry that share a salt, about, and members of a partition.
SALT_ROWS, PARTITION_ROWS = 2048, 400_000
#: Distances are computed for this many members at once.
SLICE = 8192


@dataclass
class Members:
    """Parts of vectors, column by column: vector's row number, position, entry, components."""

    row: np.ndarray
    position: np.ndarray
    entry: np.ndarray
    value: np.ndarray

    def take(self, at: np.ndarray) -> Members:
        return Members(self.row[at], self.position[at], self.entry[at], self.value[at])


def joined(some: list[Members]) -> Members:
    return Members(*(np.concatenate([getattr(m, f) for m in some]) for f in ("row", "position", "entry", "value")))


def nearest(value: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest entry, ties to the lower index, and the squared distance. Exact: floats only where they hold all sums."""
    entry, distance = np.empty(len(value), np.int64), np.empty(len(value), np.int64)
    most = max(int(np.abs(value).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    kind = np.float64 if 4 * most * most * max(1, value.shape[1]) < 1 << 52 else np.int64
    b = book.astype(kind)
    norm = (b * b).sum(1)
    for at in range(0, len(value), SLICE):
        v = value[at : at + SLICE].astype(kind)
        score = norm - 2 * (v @ b.T)
        best = score.argmin(1)
        entry[at : at + SLICE] = best
        distance[at : at + SLICE] = score[np.arange(len(v)), best] + (v * v).sum(1)
    return entry, distance


def assigned(m: Members, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    entry, distance = np.empty(len(m.row), np.int64), np.empty(len(m.row), np.int64)
    for p, book in enumerate(books):
        at = np.flatnonzero(m.position == p)
        entry[at], distance[at] = nearest(m.value[at], book)
    return entry, distance


def owner_of(m: Members, salts: int) -> np.ndarray:
    """The owner's key of each member, from (position, entry, salt)."""
    salt = mix(m.row.astype(np.uint64)) % np.uint64(salts)
    with np.errstate(over="ignore"):
        return (mix((m.position.astype(np.uint64) * np.uint64(ENTRIES) + m.entry.astype(np.uint64)) * np.uint64(1 << 32) + salt) >> np.uint64(33)).astype(np.int64)


def same(key: int) -> int:
    """The partitioner of all rounds: one function, so that Spark sees one partitioner."""
    return key


def sent(m: Members, salts: int, partitions: int) -> Iterator[tuple[int, Members]]:
    """Members by the partition of their owner."""
    to = owner_of(m, salts) % partitions
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(to[at[0]]), m.take(at)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (integers), row (a number of its own): the rows that take part, staged."""
    rows = exact(vectors, "vec_id", "label", "embedding").where(F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-1.0 * LIMIT)), F.lit(1.0 * LIMIT))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return staged(rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", "label", whole.alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")


class Lloyd:
    """The state of the rounds: members with their owners, and the codebooks."""

    def __init__(self, rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES):
        self.spark: SparkSession = rows.sparkSession
        n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        self.rows, self.n, self.parts = rows, n, parts
        self.width = width = -(-(longest or 0) // parts)
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
        start = np.zeros((len(first), width * parts), np.int64)
        for i, r in enumerate(first):
            start[i, : len(r.v)] = r.v
        self.books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
        self.moved: list[int] = []
        salts = max(1, -(-n // SALT_ROWS))
        partitions = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n * parts // PARTITION_ROWS))
        books = self.books

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pickle

            for b in batches:
                v, at = b.column(1), 0
                flat, ends = v.flatten().to_numpy(), np.cumsum(v.value_lengths().to_numpy())
                value = np.zeros((len(b), width * parts), np.int32)
                lengths = np.diff(np.concatenate([[0], ends]))
                at = np.repeat(np.arange(len(b)), lengths)
                value[at, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
                row = np.tile(b.column(0).to_numpy(), parts)
                m = Members(row, np.repeat(np.arange(parts), len(b)), np.zeros(len(row), np.int64), np.concatenate([value[:, p * width : (p + 1) * width] for p in range(parts)]))
                m.entry, _ = assigned(m, books)
                out = list(sent(m, salts, partitions))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([pickle.dumps(x) for _, x in out], pa.binary())], ["key", "members"])

        def unpacked(r) -> tuple[int, Members]:
            import pickle

            return r.key, pickle.loads(r.members)

        dealt = rows.select("row", "v").mapInArrow(cut, "key long, members binary").rdd.map(unpacked)
        self.state: RDD = dealt.partitionBy(partitions, same)
        self.salts, self.partitions = salts, partitions
        self.held: list[RDD] = []

    def update(self) -> None:
        """The next codebooks from the owners' sums; entries without members stay."""

        def sums(blocks: Iterator[tuple[int, Members]]) -> Iterator[tuple[tuple[int, int], list[int]]]:
            total: dict[tuple[int, int], list[int]] = {}
            for _, m in blocks:
                key = m.position * ENTRIES + m.entry
                order = np.argsort(key, kind="stable")
                begins = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
                added = np.add.reduceat(m.value[order].astype(np.int64), begins, axis=0) if m.value.shape[1] else np.zeros((len(begins), 0), np.int64)
                for k, n, s in zip(key[order][begins].tolist(), np.diff(np.append(begins, len(order))).tolist(), added.tolist(), strict=True):
                    old = total.get(k)
                    total[k] = [n, *s] if old is None else [a + b for a, b in zip(old, [n, *s], strict=True)]
            yield from total.items()

        found = self.state.mapPartitions(sums).reduceByKey(lambda a, b: [x + y for x, y in zip(a, b, strict=True)]).collect()
        for key, (n, *s) in found:
            p, e = divmod(key, ENTRIES)
            self.books[p][e] = [x // n for x in s]

    def migrate(self) -> None:
        """Assigns all members again where they are; those whose entry changes go to its owner."""
        books, salts = self.spark.sparkContext.broadcast(self.books), self.salts
        partitions = self.state.getNumPartitions()

        def again(blocks: Iterator[tuple[int, Members]]) -> Iterator[tuple[str, int, Members]]:
            for key, m in blocks:
                entry, _ = assigned(m, books.value)
                goes = entry != m.entry
                m.entry = entry
                if not goes.all():
                    yield "stay", key, m.take(np.flatnonzero(~goes))
                if goes.any():
                    for to, some in sent(m.take(np.flatnonzero(goes)), salts, partitions):
                        yield "go", to, some

        def gathered(blocks: Iterator[tuple[int, Members]]) -> Iterator[tuple[int, Members]]:
            some = list(blocks)
            if some:
                yield some[0][0], joined([m for _, m in some])

        from pyspark import StorageLevel

        tried = self.state.mapPartitions(again, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(tried)
        stay = tried.filter(lambda x: x[0] == "stay").mapPartitions(lambda xs: ((k, m) for _, k, m in xs), preservesPartitioning=True)
        go = tried.filter(lambda x: x[0] == "go").map(lambda x: (x[1], x[2]))
        self.moved.append(go.map(lambda x: len(x[1].row)).sum())
        self.state = stay.union(go.partitionBy(partitions, same)).mapPartitions(gathered, preservesPartitioning=True)

    def codes(self) -> DataFrame:
        """row, code, error with the present codebooks."""
        books = self.spark.sparkContext.broadcast(self.books)

        def final(blocks: Iterator[tuple[int, Members]]) -> Iterator[tuple[bytes]]:
            for _, m in blocks:
                entry, distance = assigned(m, books.value)
                batch = pa.RecordBatch.from_arrays([pa.array(m.row), pa.array(m.position, pa.int64()), pa.array(entry), pa.array(distance)], ["row", "position", "entry", "error"])
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as w:
                    w.write_batch(batch)
                yield (out.getvalue().to_pybytes(),)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in b.column(0):
                    yield from pa.ipc.open_stream(x.as_py())

        parts = self.spark.createDataFrame(self.state.mapPartitions(final), "block binary").mapInArrow(read, "row long, position long, entry long, error long")
        digits = 2 * self.parts
        code = F.sum(F.expr(f"shiftleft(entry, cast(8 * ({self.parts} - 1 - position) AS int))"))
        return parts.groupBy("row").agg(F.lower(F.lpad(F.hex(code), digits, "0")).alias("code"), F.sum("error").alias("error"))


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimals, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(vec_id, label, code, error) of each vector that takes part, the codebooks, and how many parts moved in each round."""
    if not 0 < entries <= ENTRIES or not 0 < parts <= 7:
        raise ValueError("codes have two hex digits a part, and at most seven parts")
    rows = integers(vectors, scale)
    lloyd = Lloyd(rows, parts, entries)
    if lloyd.n:
        for k in range(rounds):
            lloyd.update()
            if k + 1 < rounds:
                lloyd.migrate()
    done = staged(lloyd.codes(), "codes")
    for r in lloyd.held:
        r.unpersist()
    return rows.select("row", "vec_id", "label").join(done, "row").drop("row"), lloyd.books, lloyd.moved


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books, _ = encode(vectors)
    coded = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    coded = staged(coded, "coded")
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    out = skew_join(coded, sums, "key", "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL, for vectors of one length that the parts divide."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM
  (SELECT v.row, v.p, b.e, (v.n + b.n - 2 * list_inner_product(v.v, b.b))::BIGINT AS d FROM v JOIN b{r} AS b ON v.p = b.p) GROUP BY row, p)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS c FROM (SELECT a.p, a.e, unnest(v.v)::BIGINT AS x, generate_subscripts(v.v, 1) AS i FROM a{r} AS a JOIN v USING (row, p)) GROUP BY p, e, i),
u{r} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i)::DOUBLE[] AS b FROM s{r} GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.b, b.b) AS b, list_inner_product(coalesce(u.b, b.b), coalesce(u.b, b.b)) AS n FROM b{r} AS b LEFT JOIN u{r} AS u USING (p, e))""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row, p::INT AS p, w AS v, list_inner_product(w, w) AS n FROM (SELECT row, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS w FROM k, range({parts}) AS r(p))),
b0 AS MATERIALIZED (SELECT p, row AS e, v AS b, n FROM v WHERE row < {entries}),{",".join(steps)},
c AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN c USING (row), h"""
