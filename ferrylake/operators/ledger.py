"""The id-to-key ledger: its states, counts, updates and queries.

A row that is absent was never seen; one without target key was skipped; one with a key has moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.operators.resolve import numbered
from ferrylake.schemas import LEDGER

KEY = ["src_id", "type"]


def is_skipped() -> Column:
    return F.col("tgt_key").isNull()


def has_moved() -> Column:
    return F.col("tgt_key").isNotNull()


def pending(rows: DataFrame, ledger: DataFrame, id_column: str, kind: str) -> DataFrame:
    """Source rows that the ledger does not know."""
    return rows.join(ledger.where(F.col("type") == kind).select(F.col("src_id").alias(id_column)), id_column, "left_anti")


def known(rows: DataFrame, ledger: DataFrame, id_column: str, kind: str, moved: bool = False) -> DataFrame:
    some = ledger.where((F.col("type") == kind) & (has_moved() if moved else F.lit(True)))
    return rows.join(some.select(F.col("src_id").alias(id_column)), id_column, "left_semi")


def with_state(rows: DataFrame, ledger: DataFrame, id_column: str, kind: str) -> DataFrame:
    """Adds state (absent, skipped, moved), tgt_key as a number, and partition_id."""
    mine = ledger.where(F.col("type") == kind).select(F.col("src_id").alias(id_column), F.col("tgt_key").cast("long").alias("tgt_key"), "partition_id", F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "absent").when(F.col("tgt_key").isNull(), "skipped").otherwise("moved")
    return rows.join(mine, id_column, "left").withColumn("state", state).drop("_known")


def counts(ledger: DataFrame) -> DataFrame:
    """Skipped and moved rows of each type."""
    return ledger.groupBy("type").agg(F.count_if(is_skipped()).alias("skipped"), F.count_if(has_moved()).alias("moved"))


def latest(ledger: DataFrame) -> DataFrame:
    """Of each type the latest time (nulls don't count) and the largest id as text, skipped rows included."""
    return ledger.groupBy("type").agg(F.max("create_time").alias("latest_time"), F.max("src_id").alias("latest_id"))


def listing(ledger: DataFrame, moved: bool = False) -> DataFrame:
    """position, line: of each type a header with the number of its skipped rows and their ids, or of its moved rows and their ids with keys.

    Types, and ids within a type, are in the order of their text. Types without such rows have a header, too.
    """
    is_there = has_moved() if moved else is_skipped()
    heads = ledger.groupBy("type").agg(F.count_if(is_there).alias("n")).select("type", F.lit("").alias("id"), F.concat("type", F.lit(": "), F.col("n").cast("string"), F.lit(" moved" if moved else " skipped")).alias("line"))
    line = F.concat(F.lit("  "), "src_id", F.lit(" -> "), "tgt_key") if moved else F.concat(F.lit("  "), "src_id")
    rows = ledger.where(is_there).select("type", F.col("src_id").alias("id"), line.alias("line"))
    levels = heads.withColumn("level", F.lit(0)).unionByName(rows.withColumn("level", F.lit(1)))
    return numbered(levels, "type", "level", "id").select("position", "line")


def upsert(ledger: DataFrame, delta: DataFrame, save_reason: bool = False) -> DataFrame:
    """The next snapshot. `delta`: src_id, type, tgt_key, create_time, skip_reason, partition_id of what was tried.

    A key clears the reason. A failed retry changes the reason only, and not even that unless reasons are saved.
    The partition is only replaced by one that is not null. Rows that moved before stay as they are.
    """
    old, new = ledger.alias("o"), delta.alias("n")
    joined = old.join(new, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in KEY], "full_outer")
    seen, tried = F.col("o.src_id").isNotNull(), F.col("n.src_id").isNotNull()
    reason = F.col("n.skip_reason") if save_reason else F.lit(None).cast("string")
    moved_before = seen & F.col("o.tgt_key").isNotNull()
    now_moves = tried & F.col("n.tgt_key").isNotNull()
    failed_again = F.col("n.skip_reason") if save_reason else F.col("o.skip_reason")
    columns = {
        "src_id": F.coalesce("o.src_id", "n.src_id"),
        "tgt_key": F.coalesce("o.tgt_key", "n.tgt_key"),
        "type": F.coalesce("o.type", "n.type"),
        "create_time": F.when(seen, F.col("o.create_time")).otherwise(F.col("n.create_time")),
        "skip_reason": F.when(moved_before | ~tried, F.col("o.skip_reason")).when(now_moves, None).when(seen, failed_again).otherwise(reason),
        "partition_id": F.when(moved_before, F.col("o.partition_id")).otherwise(F.coalesce(F.when(now_moves | ~seen, F.col("n.partition_id")), F.col("o.partition_id"))),
    }
    return joined.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in LEDGER))


def delete(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the given ids, whatever their type."""
    return ledger.join(ids.select("src_id"), "src_id", "left_anti").select(*(f.name for f in LEDGER))


def retry_queue(ledger: DataFrame, source: DataFrame, id_column: str, kind: str) -> DataFrame:
    """Skipped rows with whether their source is still there; those that vanished are not tried again."""
    there = source.select(F.col(id_column).alias("src_id"), F.lit(True).alias("present"))
    return ledger.where((F.col("type") == kind) & is_skipped()).join(there, "src_id", "left").select("src_id", F.coalesce("present", F.lit(False)).alias("present"))


def route(state: Column, reason: Column) -> Column:
    """What happens to a row that was checked: start, insert as skipped, or update its reason."""
    return F.when(reason.isNull(), "start").when(state == "absent", "insert skipped").otherwise("update reason")


def may_start(state: Column, mode: str) -> Column:
    """A retry takes all; a first run only what the ledger does not know."""
    return F.lit(True) if mode == "retry" else state == "absent"
