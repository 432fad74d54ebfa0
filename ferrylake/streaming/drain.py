"""Incremental processing: a drain loop over files as a stream that ends, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylake.operators import pipeline as P
from ferrylake.operators.ledger_table import LedgerTable
from ferrylake.operators.pipeline import Pipeline
from ferrylake.schemas import LEGACY_ID
from ferrylake.sources.staging import staged


def drain(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], per_trigger: int = 100) -> None:
    """Takes new files, `per_trigger` at a time, until there are none; a repeated call takes only what came since."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    query = transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_into(spark: SparkSession, path: str, schema: T.StructType, ledger: LedgerTable, spec: Pipeline, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda rows: rows, per_trigger: int = 100, after: Callable[[int], None] | None = None, **how: object) -> None:
    """Takes new files, `per_trigger` at a time, through a type's path into the ledger, until there are none.

    A batch's snapshot has the stream's and the batch's name. A stream that dies after a snapshot and before its own commit
    gives the same batch again: it finds its snapshot published and changes nothing. One that dies before the pointer is
    written leaves a folder that the next try writes anew. So each row counts once. `after` is called with each batch's
    number when its snapshot is there.
    """
    stream = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def take(batch: DataFrame, number: int) -> None:
        name = f"snapshot-{stream}-{number}"
        if not ledger.has(spec.kind, name):
            rows = staged(P.tried(batch, ledger, spec, **how), "tried")
            ledger.upsert(spec.kind, P.delta(rows, spec), name=name)
        if after:
            after(number)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    transform(rows).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def not_externally_started(rows: DataFrame, variables: str) -> DataFrame:
    """Rows whose variables carry the id that a moved instance has."""
    return rows.where(F.coalesce(F.col(variables).contains(LEGACY_ID), F.lit(False)))


def windowed(rows: DataFrame, time: str, key: str, size: str, late: str) -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped by a stream."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
