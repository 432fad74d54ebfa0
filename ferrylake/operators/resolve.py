"""Resolution of parents, ordered reasons, first and latest rows, references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrylake.sources.staging import staged


def first_reason(rules: list[tuple[Column, str | Column]]) -> Column:
    """The text of the first rule that fails, in the order given; null if none does."""
    return F.coalesce(*(F.when(failed, F.lit(text) if isinstance(text, str) else text) for failed, text in rules))


def first_failure(rows: DataFrame, group: str, order: list[str], rules: list[tuple[Column, str | Column]]) -> DataFrame:
    """Of each group the reason of the first row, in `order`, that has one. Groups without are there with null."""
    return rows.withColumn("_r", first_reason(rules)).groupBy(group).agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.struct(*order))).alias("reason"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the total order `order`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the total order `order`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def find_one(rows: DataFrame, others: DataFrame, on: list[str], value: str) -> DataFrame:
    """The one match of each row. More than one is ambiguous and none is missing; both leave the value null."""
    by = others.groupBy(*on).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    joined = rows.join(by, on, "left")
    outcome = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("found")
    return joined.withColumn("outcome", outcome).withColumn(value, F.when(F.col("_n") == 1, F.col("_v"))).drop("_n", "_v")


def inherit_partition(rows: DataFrame, ledger: DataFrame, root: str, kind: str, drawn: Column) -> DataFrame:
    """A child has its root's partition. Without a root it gets `drawn`; with one that has not moved, null."""
    roots = ledger.where((F.col("type") == kind) & F.col("tgt_key").isNotNull()).select(F.col("src_id").alias(root), F.col("partition_id").alias("_p"))
    return rows.join(roots, root, "left").withColumn("partition_id", F.when(F.col(root).isNull(), drawn).otherwise(F.col("_p"))).drop("_p")


def ordered_map(rows: DataFrame, scope: str, name: str, value: str, order: list[str]) -> DataFrame:
    """Name-value rows of each scope, the last write of a name wins."""
    return latest_by(rows.select(scope, name, value, *order), [scope, name], order).select(scope, name, value)


def as_map(rows: DataFrame, scope: str, name: str, value: str) -> DataFrame:
    """One map a scope. A scope's rows meet in one place; use long rows where scopes may be large."""
    return rows.groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("variables"))


def collect_references(messages: DataFrame, references: DataFrame) -> DataFrame:
    """Own messages of each element, then those of every element that it refers to.

    messages: element, position, message; references: element, ordinal, target. Long rows in order, nothing is gathered.
    """
    own = messages.select("element", F.lit(-1).alias("ordinal"), "position", "message")
    other = references.join(messages.select(F.col("element").alias("target"), "position", "message"), "target").select("element", "ordinal", "position", "message")
    return own.unionByName(other)


def retry_to_fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """Repeats `step` while some rows are skipped and their number falls. `state` has tgt_key; each round is staged. More than `most` rounds are an error."""
    now = staged(state, "fixpoint")
    left = now.where("tgt_key IS NULL").count()
    for _ in range(most):
        if not left:
            return now
        after = staged(step(now), "fixpoint")
        n = after.where("tgt_key IS NULL").count()
        if n > left:
            raise RuntimeError("a retry must not skip more than before")
        now, done, left = after, n == left, n
        if done:
            return now
    raise RuntimeError(f"rows still move after {most} rounds")


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `position`, from 1, in a total order. Rows are sorted in ranges; only counts of ranges meet in one place."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() % (1 << 33)), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("position", F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def hot_keys(counts: DataFrame, on: list[str], n: str) -> list[int]:
    """Hashes of the keys that have over a thousandth of all rows, and so a thousand at most."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(total // 1000, HOT_ROWS)).select(F.xxhash64(*on)).collect()]


#: A key with fewer rows is not hot.
HOT_ROWS = 10_000


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "left", shares: int = 16, hot: list[int] | None = None) -> DataFrame:
    """Joins many rows with few, where some keys have a large part of the left rows.

    Left rows of a key are dealt to `shares` tasks by a hash of `by`, right rows are there once for each share. With `hot`
    (hashes of `hot_keys`) this holds for these keys only, and right rows of all others are there once. `how` is
    inner or left. Shares that are still too large are split by adaptive execution. Right rows are never broadcast: the size of
    their files says nothing of their copies.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"{how}: right rows are repeated, so only inner and left joins are right")
    if hot is not None and not hot:
        return left.join(right.hint("merge"), on, how)
    # A key that only shares its hash with a hot one is dealt on both sides, too.
    many = F.lit(True) if hot is None else F.xxhash64(*on).isin(hot)
    dealt = left.withColumn("_share", F.when(many, F.pmod(F.xxhash64(by), F.lit(shares))).otherwise(0).cast("int"))
    copies = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.when(many, shares - 1).otherwise(0))))
    return dealt.join(copies.hint("merge"), [*on, "_share"], how).drop("_share")
