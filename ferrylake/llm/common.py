"""Helpers that the training-data operators share: staging, skew-safe joins, components, text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one where it is unset and all runs in one process."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='ferrylake-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes `df` as Parquet under `shared_dir` and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, found by their exact names, even where others differ from them in case alone."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"own{i}" for i in range(len(df.columns)))).select(*(F.col(f"own{i}").alias(n) for i, n in zip(at, names, strict=True)))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; resolved where it is called, so tasks find their own copy."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Lists of ids up to this length are broadcast; longer ones meet their rows in a shuffle.
BROADCAST_IDS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `df` whose `column` is among the distinct values of `ids`' same column. Wide rows don't move while the ids are few."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, column, "left_semi")


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot_keys: list | None = None) -> DataFrame:
    """Joins many `left` rows to unique `right` keys. `how` is left or inner. `hot_keys`: where the caller knows them.

    Hot keys of `left` (more than 1/HOT_SHARE of its rows, so HOT_SHARE keys at most) meet a broadcast of their
    `right` rows; all others meet in an ordinary shuffle join. `right` rows must be narrow. Null keys match nothing.
    """
    if hot_keys is None:
        total = max(left.count(), 100_000)
        by = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") * HOT_SHARE > total))
        hot_keys = [r[0] for r in by.select(key).take(HOT_SHARE)]
    if not hot_keys:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot_keys), F.lit(False))
    some = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot_keys))), key, how)
    return left.where(~is_hot).join(right.where(~F.col(key).isin(hot_keys)), key, how).unionByName(some)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges` (a, b): undirected. Returns (node, component) for every node with an edge; component is its smallest node.

    Alternating large-star and small-star rounds; each round is a min by key and a join, staged in the shared folder.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both, low, "u", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, low, "u", "inner")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = staged(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))


# --- hashing of words, vectorised over a batch of texts -------------------------------------------------------------

MASK_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MASK_MULT)
_BYTES_LOWER = _BYTES[_LOWER]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _STEP), ("down", _STEP_INV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts have about `limit` bytes together; one row at least."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32, len(column) + 1, column.offset * (8 if pa.types.is_large_string(column.type) else 4))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, len(column))
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offset of each text in them."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) and the first word of each text, with an end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[edges - 1] = word[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTES_LOWER if lower else _BYTES)[raw] * up[:n], out=total[1:])
        h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * MASK_MULT)
    return h, np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of k-word shingles; of all words as one, if fewer; empty without words."""
    raw, offsets = text_bytes(column)
    h, first = word_hashes(raw, offsets)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            acc = mix(acc * _STEP + h[j : j + len(acc)])
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(acc[a : b - k + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for x in h[a:b]:
                    one = mix(one * _STEP + x + MASK_MULT)
                yield one
            else:
                yield acc[:0]
