"""Staging in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a temporary folder where it is unset and all runs in one process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='ferrylake-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes `df` and reads it back: a cut in the lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_count(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """`staged`, and how many rows it has: counted while they are written, without another pass."""
    seen = Observation()
    done = staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return done, int(seen.get["n"])
