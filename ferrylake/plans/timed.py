"""Queries over time: forms by binding, and a stream of events drained into the ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.operators.asof import form_versions
from ferrylake.operators.ledger_table import LedgerTable
from ferrylake.operators.pipeline import Pipeline, Rule, run
from ferrylake.sources.scans import table
from ferrylake.sources.sinks import target_tables
from ferrylake.sources.staging import shared_dir
from ferrylake.streaming.drain import drain_into


def form_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of their customer's form, line items as asks with all bindings, one of them unknown."""
    versions = table(spark, d, "orders").selectExpr("o_custkey AS form", "o_orderdate AS created", "o_orderkey % 50 AS version", "o_orderkey % 7 AS deployment", "IF(o_orderkey % 3 = 0, null, o_orderpriority) AS tag", "o_orderkey AS form_id")
    asks = table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS ask", "l_suppkey AS form", "l_shipdate AS at", "element_at(array('latest', 'deployment', 'version', 'versionTag', 'other'), cast((l_orderkey + l_linenumber) % 5 AS int) + 1) AS binding",
        "CASE (l_orderkey + l_linenumber) % 5 WHEN 1 THEN cast(l_orderkey % 9 AS string) WHEN 2 THEN cast(l_partkey % 60 AS string) WHEN 3 THEN '1-URGENT' END AS wanted",
    )
    return form_versions(asks, versions).select("ask", "form_id", "outcome")


FORM_BINDINGS = """
WITH v AS (SELECT o_custkey AS form, o_orderdate AS created, o_orderkey % 50 AS version, o_orderkey % 7 AS deployment, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS tag, o_orderkey AS form_id FROM orders),
a AS (SELECT l_orderkey * 10 + l_linenumber AS ask, row_number() OVER () AS r, l_suppkey AS form, l_shipdate AS moment, (l_orderkey + l_linenumber) % 5 AS b, l_orderkey % 9 AS dep, l_partkey % 60 AS ver FROM lineitem),
f AS (SELECT r, arg_max(form_id, (created, form_id)) AS form_id FROM a JOIN v USING (form)
  WHERE CASE b WHEN 0 THEN created <= moment WHEN 1 THEN deployment = dep WHEN 2 THEN version = ver WHEN 3 THEN tag = '1-URGENT' ELSE false END GROUP BY r)
SELECT ask, form_id, CASE WHEN b = 4 THEN 'unknown binding' WHEN form_id IS NULL THEN 'missing' ELSE 'found' END AS outcome FROM a LEFT JOIN f USING (r)"""

JOB = Pipeline("job", "event_id", "ts", (Rule("event_type NOT IN ('click', 'purchase')", "only asynchronous jobs move"),))


def drain_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files, through the path of jobs into a ledger of its own."""
    at = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    ledger = LedgerTable(spark, f"{at}/ledger")
    drain_into(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, ledger, JOB, f"{at}/state", counter=lambda x: x.cast("long"), drawn=F.pmod(F.col("event_id"), F.lit(3)) + 1)
    return ledger.read("job").select("src_id", "tgt_key", "skip_reason", "partition_id")


DRAIN_LEDGER = """
SELECT event_id::VARCHAR AS src_id, CASE WHEN m THEN (4095::BIGINT * 2251799813685248 + event_id)::VARCHAR END AS tgt_key, CASE WHEN NOT m THEN 'only asynchronous jobs move' END AS skip_reason,
  CASE WHEN m THEN (event_id % 3 + 1)::INTEGER END AS partition_id FROM (SELECT event_id, event_type IN ('click', 'purchase') AS m FROM events)"""


TAGGED = Pipeline("process instance", "id", "started", (Rule("status = 'P'", "is still pending"),))


def target_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is written to the target for instances with tags: the entity's rows, a row a tag, and the counts of the run."""
    at, counts, written = f"{shared_dir(spark)}/target-{uuid.uuid4().hex}", {}, {}
    source = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS started", "o_orderstatus AS status", "CASE o_orderkey % 3 WHEN 0 THEN split(o_orderpriority, '-') WHEN 1 THEN array() END AS tags")
    run(
        {"process instance": source}, LedgerTable(spark, f"{at}/ledger"), [TAGGED], lambda s, rows: written.update(target_tables(rows, f"{at}/{s.kind.replace(' ', '-')}", {"tags": "tags"})), counts=counts, counter=lambda x: x.cast("long")
    )
    read = lambda name: spark.read.parquet(f"{at}/process-instance/{name}")
    moved, skipped = counts["process instance"]
    sums = spark.createDataFrame([("moved", moved), ("skipped", skipped), *((f"rows of {k}", n) for k, n in written.items())], "part string, position long")
    entity = read("entity").select(F.lit("entity").alias("part"), "tgt_key", F.col("own.id").alias("position"), F.col("own.status").alias("child"))
    tags = read("tags").select(F.lit("tags").alias("part"), "tgt_key", F.col("position").cast("long").alias("position"), "child")
    return entity.unionByName(tags).unionByName(sums.select("part", F.lit(None).cast("string").alias("tgt_key"), "position", F.lit(None).cast("string").alias("child")))


TARGET_ROWS = """
WITH m AS (SELECT *, (4095::BIGINT * 2251799813685248 + o_orderkey)::VARCHAR AS key FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT key, unnest(string_split(o_orderpriority, '-')) AS child, generate_subscripts(string_split(o_orderpriority, '-'), 1) - 1 AS position FROM m WHERE o_orderkey % 3 = 0)
SELECT 'entity' AS part, key AS tgt_key, o_orderkey AS position, o_orderstatus AS child FROM m UNION ALL SELECT 'tags', key, position, child FROM t
UNION ALL SELECT 'moved', NULL, count(*), NULL FROM m UNION ALL SELECT 'skipped', NULL, count(*), NULL FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'rows of entity', NULL, count(*), NULL FROM m UNION ALL SELECT 'rows of tags', NULL, count(*), NULL FROM t"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (form_bindings, drain_ledger, target_rows)}


def oracle_sql() -> dict[str, str]:
    return {"form_bindings": FORM_BINDINGS, "drain_ledger": DRAIN_LEDGER, "target_rows": TARGET_ROWS}
