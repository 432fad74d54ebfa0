"""Coverage of one API's endpoints by another's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.operators.resolve import first_by


def coverage(source: DataFrame, mapping: DataFrame, target: DataFrame) -> DataFrame:
    """Each source operation with its first mapping and that mapping's first target operation.

    source: path, operation; mapping: path, operation, ordinal, target_path, target_operation, discontinued; target:
    target_path, target_operation, target_summary, ordinal. status: to be decided, discontinued, unknown target, mapped.
    """
    first = first_by(mapping, ["path", "operation"], ["ordinal"]).withColumn("_mapped", F.lit(True)).drop("ordinal")
    there = first_by(target, ["target_path", "target_operation"], ["ordinal"]).withColumn("_there", F.lit(True)).drop("ordinal")
    joined = source.join(first, ["path", "operation"], "left").join(there, ["target_path", "target_operation"], "left")
    status = F.when(F.col("_mapped").isNull(), "to be decided").when(F.col("discontinued"), "discontinued").when(F.col("_there").isNull(), "unknown target").otherwise("mapped")
    return joined.withColumn("status", status).drop("_mapped", "_there")


def sections(operations: DataFrame) -> DataFrame:
    """tag, path, operation: all operations of a path stand in a section if any of them has its tag."""
    tags = operations.select("path", F.explode("tags").alias("tag")).distinct()
    return tags.join(operations.select("path", "operation").distinct(), "path")


def shown(path: Column, operation: Column, status: Column, text: str = "", method: str | None = None, hide_open: bool = False, only: str | None = None) -> Column:
    """Filters of an endpoint list: all must hold. The text is looked for as it is written."""
    out = path.contains(text)
    if method:
        out &= operation == method
    if hide_open:
        out &= status != "to be decided"
    return out & (status == only) if only else out


def ordered(endpoints: DataFrame, summary: str, path: str, ordinal: str) -> DataFrame:
    """By summary; of equal ones those of a tenant last, then as given."""
    return endpoints.orderBy(summary, F.col(path).contains("tenant-id"), ordinal)
