"""Pointer chains in a logarithmic number of rounds, and numbers from hashes that never collide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.sources.staging import staged, staged_count


def resolve_chains(rows: DataFrame) -> DataFrame:
    """id, good, part of each row: whether it and all above it are good, and the part of the one at the top.

    rows: id (unique), up (the row above, or null), good, part. A row whose `up` is not among the rows is not good, nor are
    rows of a cycle and those below one. Each round doubles how far a row looks: what it points at is either settled, or hands
    on its own pointer, so a chain of n rows takes log2(n) rounds. Only open rows are written again. Many rows below one are
    a hot key of a join that adaptive execution splits.
    """
    first = staged(rows.select("id", F.when(F.col("good"), F.col("up")).alias("up"), F.coalesce("good", F.lit(False)).alias("good"), "part", (F.col("up").isNull() | ~F.coalesce("good", F.lit(False))).alias("done")), "chains")
    settled, open_rows = [first.where("done")], first.where("NOT done")
    n, left = open_rows.count(), None
    while n and n != left:
        left = n
        known = reduce(DataFrame.unionByName, settled).unionByName(open_rows)
        b = known.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("good").alias("_good"), F.col("part").alias("_part"), F.col("done").alias("_done"))
        done = F.coalesce("_done", F.lit(True))
        after = staged(
            open_rows.select("id", "up", "part").join(b, "up", "left").select("id", F.when(~done, F.col("_up")).alias("up"), F.coalesce("_good", F.lit(False)).alias("good"), F.when(done, F.col("_part")).otherwise(F.col("part")).alias("part"), done.alias("done")), "chains"
        )
        settled.append(after.where("done"))
        open_rows = after.where("NOT done")
        n = open_rows.count()
    stuck = open_rows.withColumn("good", F.lit(False))
    return reduce(DataFrame.unionByName, [*settled, stuck]).select("id", "good", "part")


def distinct_numbers(ids: DataFrame, id_column: str, seed: str, modulus: int, taken: DataFrame | None = None) -> DataFrame:
    """id_column and `number`, below `modulus`, of each id: no two ids share one, and none is among `taken` (number).

    Numbers are hashes of seed, id and round. Where ids meet in one number the smallest id keeps it, and only the others go on
    to the next round; a number that was given once is not given again. With 2**51 numbers the first round is the last for
    all but a few. The same ids and taken numbers give the same result. Repeated ids count once, null ids are left out.
    """
    todo, left = staged_count(ids.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("id")).distinct(), "numbers")
    used = taken.select(F.col("number").cast("long").alias("number")).distinct() if taken is not None else None
    if left + (used.count() if used is not None and modulus < 1 << 32 else 0) > modulus:
        raise ValueError(f"{left} ids don't fit into {modulus} numbers")
    given, turn = [], 0
    while left:
        number = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(turn)), F.lit(modulus))
        winners = todo.withColumn("number", number).groupBy("number").agg(F.min("id").alias("id"))
        for old in [used, *given] if used is not None else given:
            winners = winners.join(old.select("number"), "number", "left_anti")
        done, n = staged_count(winners.select("id", "number"), "numbers")
        given.append(done)
        if n < left:
            todo = staged(todo.join(given[-1], "id", "left_anti"), "numbers")
        left, turn = left - n, turn + 1
    out = reduce(DataFrame.unionByName, given) if given else todo.withColumn("number", F.lit(0).cast("long")).where("false")
    return out.select(F.col("id").alias(id_column), "number")
