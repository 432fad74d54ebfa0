"""Queries over resumed scans of all types, pages, local times and listings of the ledger."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions.scalars import local_time
from ferrylake.operators import ledger as L
from ferrylake.operators.resume import Scan, due, resumed
from ferrylake.sources import scans
from ferrylake.sources.scans import table

#: Rows before this time are known to the ledger, but for every third.
KNOWN = "1996-01-01"

_NODE = "l_orderkey * 10 + l_linenumber"
_EVENT = ("events", "event_id", "ts")
#: (scan, table, id, time, tie, detail) of each variant, in SQL that both engines read. Time and tie are named so in the scan.
SCANS = (
    (Scan("process instance", "id", "time"), "orders", "o_orderkey", "o_orderdate", "NULL", "o_orderstatus"),
    (Scan("decision instance", "id", "time", only="tie IS NULL"), "orders", "o_orderkey", "o_orderdate", "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - 1 END", "NULL"),
    (Scan("process definition", "id", "time"), *_EVENT, "NULL", "event_type"),
    (Scan("process definition of a key", "id", "time", only="detail = 'view'"), *_EVENT, "NULL", "event_type"),
    (Scan("decision definition", "id", "time"), "lineitem", _NODE, "l_shipdate", "NULL", "l_linestatus"),
    (Scan("decision requirements", "id", "time"), "orders", "o_orderkey", "o_orderdate", "NULL", "o_orderpriority"),
    (Scan("incident", "id", "time"), *_EVENT, "NULL", "event_type"),
    (Scan("variable", "id", "time"), *_EVENT, "NULL", "props"),
    (Scan("user task", "id", "time"), "lineitem", _NODE, "l_shipdate", "NULL", "l_returnflag"),
    (Scan("flow node", "id", "time"), "lineitem", _NODE, "l_shipdate", "NULL", "l_returnflag"),
    (Scan("audit log", "id", "time", ("tie",)), *_EVENT, "user_id", "event_type"),
    (Scan("job", "id", "time", ("tie",)), *_EVENT, "user_id", "event_type"),
    (Scan("external task", "id", "time", ("tie",)), *_EVENT, "user_id", "event_type"),
    (Scan("form definition", "id", "time"), "orders", "o_orderkey", "o_orderdate", "NULL", "o_orderstatus"),
)


def _values(spark: SparkSession, d: str, name: str, odd: int, value: str) -> DataFrame:
    return table(spark, d, "lineitem").where(f"l_linenumber % 2 = {odd}").selectExpr("l_orderkey AS id", f"'{name}' || l_linenumber AS name", f"CAST({value} AS STRING) AS value")


def scanned(spark: SparkSession, d: str, i: int, ordered: bool = False) -> DataFrame:
    """The rows of one variant that are due, in its order where asked. Variables keep the text of their value; decisions have their inputs and outputs."""
    scan, name, key, time, tie, detail = SCANS[i]
    rows = table(spark, d, name).selectExpr(f"{key} AS id", f"{time} AS time", f"CAST({tie} AS BIGINT) AS tie", f"CAST({detail} AS STRING) AS detail")
    known = rows.where(f"time < timestamp_ntz'{KNOWN}' AND id % 3 <> 0").select(F.lit(scan.kind).alias("type"), F.col("time").alias("create_time"))
    found = (resumed if ordered else due)(rows, scan, known.where("false") if scan.kind == "form definition" else known)
    if scan.kind != "decision instance":
        return found
    nested = scans.with_values(found, inputs=_values(spark, d, "part", 1, "l_partkey"), outputs=_values(spark, d, "supplier", 0, "l_suppkey"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",")
    return nested.withColumn("detail", F.concat(text("inputs"), F.lit(";"), text("outputs"))).drop("inputs", "outputs")


def resumed_scans(spark: SparkSession, d: str) -> DataFrame:
    """What each type's scan still has to read after a ledger that ends in its rows of 1995. Forms have no ledger and are read whole."""
    return reduce(DataFrame.unionByName, [scanned(spark, d, i).select(F.lit(s[0].kind).alias("kind"), "id", "time", "tie", "detail") for i, s in enumerate(SCANS)])


def _scan_sql(scan: Scan, name: str, key: str, time: str, tie: str, detail: str) -> str:
    late = "" if scan.kind == "form definition" else f" AND ({time} IS NULL OR NOT EXISTS (SELECT 1 FROM {name} WHERE {time} < TIMESTAMP '{KNOWN}' AND {key} % 3 <> 0) OR {time} > (SELECT max({time}) FROM {name} WHERE {time} < TIMESTAMP '{KNOWN}' AND {key} % 3 <> 0))"
    shown = "coalesce(i.t, '') || ';' || coalesce(o.t, '')" if scan.kind == "decision instance" else f"({detail})::VARCHAR"
    joins = ""
    if scan.kind == "decision instance":
        part = "LEFT JOIN (SELECT l_orderkey AS k, string_agg('{0}' || l_linenumber || '=' || {1}, ',' ORDER BY '{0}' || l_linenumber, {1}::VARCHAR) AS t FROM lineitem WHERE l_linenumber % 2 = {2} GROUP BY 1) AS {3} ON {3}.k = o_orderkey"
        joins = " " + part.format("part", "l_partkey", 1, "i") + " " + part.format("supplier", "l_suppkey", 0, "o")
    only = {"decision instance": " AND o_orderkey % 2 <> 1", "process definition of a key": " AND event_type = 'view'"}.get(scan.kind, "")
    return f"SELECT '{scan.kind}' AS kind, {key} AS id, {time} AS time, ({tie})::BIGINT AS tie, {shown} AS detail FROM {name}{joins} WHERE true{only}{late}"


def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """All pages of 100 of the events."""
    return scans.paged(["ts", "event_id"], 100, query=table(spark, d, "events").select("event_id", "ts")).select("event_id", "page")


PAGED_SCAN = "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS page FROM events"


def date_convert(spark: SparkSession, d: str) -> DataFrame:
    """Times of events, where they have one, as clocks two hours ahead of UTC show them."""
    instant = F.when(F.col("event_id") % 5 > 0, F.col("ts"))
    return table(spark, d, "events").select("event_id", local_time(instant, F.lit("+02:00")).alias("local"))


DATE_CONVERT = "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 2 HOUR END AS local FROM events"


def ledger_listing(spark: SparkSession, d: str) -> DataFrame:
    """The skipped rows of three types, one of them without any, as lines below headers."""
    def of(name: str, key: str, kind: str) -> DataFrame:
        k = F.col(key)
        return table(spark, d, name).select(k.cast("string").alias("src_id"), F.when(k % 4 > 0, k).cast("string").alias("tgt_key"), F.lit(kind).alias("type"))

    return L.listing(of("orders", "o_orderkey", "order").unionByName(of("customer", "c_custkey", "customer")).unionByName(of("part", "p_partkey", "part").where("tgt_key IS NOT NULL")))


LEDGER_LISTING = """
WITH r AS (SELECT 'order' AS type, o_orderkey::VARCHAR AS id, o_orderkey % 4 = 0 AS skipped FROM orders UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_custkey % 4 = 0 FROM customer UNION ALL SELECT 'part', p_partkey::VARCHAR, false FROM part WHERE p_partkey % 4 > 0),
l AS (SELECT type, 0 AS level, '' AS id, type || ': ' || count(*) FILTER (skipped) || ' skipped' AS line FROM r GROUP BY type UNION ALL SELECT type, 1, id, '  ' || id FROM r WHERE skipped)
SELECT row_number() OVER (ORDER BY type, level, id) AS position, line FROM l"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (resumed_scans, paged_scan, date_convert, ledger_listing)}


def oracle_sql() -> dict[str, str]:
    return {"resumed_scans": " UNION ALL ".join(_scan_sql(*s) for s in SCANS), "paged_scan": PAGED_SCAN, "date_convert": DATE_CONVERT, "ledger_listing": LEDGER_LISTING}
