"""Sinks: ledger snapshots, target tables, CSV and Markdown reports, XML, ZIP batches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions.scalars import csv_guard
from ferrylake.operators.resolve import numbered
from ferrylake.schemas import FINDING, LEDGER


def publish(df: DataFrame, path: str, name: str | None = None) -> str:
    """Writes a new snapshot folder and then its pointer; readers see the old snapshot or the new one, never a part.

    A `name` that was begun and never published is written anew.
    """
    mode, name = "overwrite" if name else "errorifexists", name or f"snapshot-{uuid.uuid4().hex}"
    df.write.mode(mode).parquet(f"{path}/{name}")
    df.sparkSession.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return name


def published(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that was published last."""
    name = spark.read.parquet(f"{path}/pointers").agg(F.max_by("name", "at")).first()[0]
    return spark.read.parquet(f"{path}/{name}")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def target_tables(rows: DataFrame, path: str, children: dict[str, str]) -> dict[str, int]:
    """One table for the entity, without its arrays of children, and one for each of these, keyed by tgt_key; rows of each.

    rows: tgt_key, partition_id, create_time, parents, own; children: name of the table to the array's column in own. An
    empty or null array gives no rows. Rows are counted as they are written.
    """
    counts: dict[str, int] = {}

    def put(df: DataFrame, name: str) -> None:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{path}/{name}")
        counts[name] = int(seen.get["n"])

    put(rows.withColumn("own", F.col("own").dropFields(*children.values())) if children else rows, "entity")
    for name, column in children.items():
        put(rows.select("tgt_key", F.posexplode(F.col(f"own.`{column}`")).alias("position", "child")), name)
    return counts


def commands(rows: DataFrame, verb: str, payload: list[str]) -> DataFrame:
    """What would be sent to the target: one row a command, payload as JSON."""
    return rows.select(F.col("src_id"), F.lit(verb).alias("verb"), F.to_json(F.struct(*payload)).alias("payload"))


def csv_report(findings: DataFrame, path: str) -> None:
    """Findings as `;`-separated text whose cells no spreadsheet takes for formulas."""
    findings.select(*(csv_guard(F.col(f.name)).alias(f.name) for f in FINDING)).write.option("sep", ";").option("header", "true").csv(path)


def markdown_report(findings: DataFrame) -> DataFrame:
    """One Markdown text a file: elements in order, severities as first seen, messages below them with their number."""
    cell = F.struct("position", "message")
    by = findings.groupBy("filename", "element_id", "element_name", "severity").agg(F.min("position").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(cell)).alias("messages"))
    part = F.concat(F.format_string("### %s (%d)\n", "severity", "n"), F.array_join(F.transform("messages", lambda m: F.concat(F.lit("- "), m["message"])), "\n"))
    by = by.withColumn("part", part).groupBy("filename", "element_id", "element_name").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "part"))).alias("parts"))
    text = F.concat(F.format_string("## %s\n", F.coalesce("element_name", "element_id")), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    return by.withColumn("text", text).groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda p: p["text"]), "\n\n").alias("report"))


def pretty_xml(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Adds `pretty`: UTF-8 text indented by two, null where the document is not well-formed."""
    @F.pandas_udf("string")
    def run(xs: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        def one(x: str | None) -> str | None:
            try:
                root = ET.fromstring(x or "")
            except ET.ParseError:
                return None
            ET.indent(root, "  ")
            return ET.tostring(root, "unicode")

        return xs.map(one)

    return docs.withColumn("pretty", run(F.col(column)))


def zip_batch(files: DataFrame, size: int = 100) -> DataFrame:
    """Batches of (filename, content) as ZIP archives of `size` files at most, one row each. Names that repeat in a batch are numbered."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            used: dict[str, int] = {}
            for name, data in sorted(((n or "unnamed", d or b"") for n, d in zip(rows.filename, rows.content, strict=True)), key=lambda x: x[0]):
                used[name] = used.get(name, 0) + 1
                stem, dot, end = name.rpartition(".")
                z.writestr(zipfile.ZipInfo(name if used[name] == 1 else f"{stem or end}-{used[name]}{dot if stem else ''}{end if stem else ''}"), data)
        return pd.DataFrame({"batch": rows.batch.iloc[:1], "files": [len(rows)], "archive": [out.getvalue()]})

    return numbered(files, "filename").withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int")).groupBy("batch").applyInPandas(run, "batch int, files int, archive binary")


def drop_allowed(ledger: DataFrame, force: bool = False) -> bool:
    """A ledger may be dropped when nothing in it is skipped, or by force."""
    return force or ledger.where("tgt_key IS NULL").isEmpty()
