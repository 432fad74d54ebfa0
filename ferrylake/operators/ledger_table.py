"""The ledger as a table of its own: one folder a type, each with snapshots and a pointer to the last."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.operators import ledger as L
from ferrylake.schemas import ENTITY_TYPES, LEDGER
from ferrylake.sources.sinks import publish, published


def no_rows(spark: SparkSession) -> DataFrame:
    """An empty ledger that the optimizer knows to be empty, so joins with it cost nothing."""
    return spark.range(0).where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER))


class LedgerTable:
    """Reads and writes touch the folder of their type only. A snapshot is complete before its pointer is written, so a run
    that ends in between leaves the old state. (src_id, type) is the key: a delta that holds one twice is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._last: dict[str, DataFrame | None] = {}

    def folder(self, kind: str) -> str:
        return f"{self.path}/type={re.sub(r'[^a-z0-9]+', '-', kind)}"

    def read(self, kind: str) -> DataFrame:
        """The type's rows; none where it was never written."""
        if self._last.get(kind) is None:
            self._last[kind] = published(self.spark, self.folder(kind)) if self._there(kind) else no_rows(self.spark)
        return self._last[kind]

    def _there(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(kind)}/pointers")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def has(self, kind: str, name: str) -> bool:
        """Was a snapshot of this name published?"""
        return self._there(kind) and not self.spark.read.parquet(f"{self.folder(kind)}/pointers").where(F.col("name") == name).isEmpty()

    def write(self, kind: str, rows: DataFrame, name: str | None = None) -> None:
        name = publish(rows, self.folder(kind), name)
        self._last[kind] = self.spark.read.schema(LEDGER).parquet(f"{self.folder(kind)}/{name}")

    def upsert(self, kind: str, delta: DataFrame, save_reason: bool = True, name: str | None = None, unique: bool = False) -> None:
        """The type's next snapshot, under a name where one is given. `delta`: what was tried of this type; `unique`: it is known to hold no id twice."""
        if not unique and not delta.groupBy("src_id").count().where("count > 1").isEmpty():
            raise ValueError(f"a {kind} is there twice")
        self.write(kind, L.upsert(self.read(kind), delta, save_reason), name)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.read(k) for k in ENTITY_TYPES])

    @classmethod
    def of(cls, ledger: DataFrame, path: str) -> LedgerTable:
        """A table with the rows of a ledger, written once for each type that it has."""
        table = cls(ledger.sparkSession, path)
        for kind in [r[0] for r in ledger.select("type").distinct().collect()]:
            if kind not in ENTITY_TYPES:
                raise ValueError(f"no type {kind}")
            table.write(kind, ledger.where(F.col("type") == kind))
        return table
