"""Queries with plug-ins: variables through a chain that fails here and there, entities in two phases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions import plugins as P
from ferrylake.sources.scans import spread, table

KINDS = ("null", "boolean", "short", "integer", "long", "double", "string", "date", "bytes", "file", "json", "xml", "object")
OWNERS = ("runtime variable", "process variable", "decision input", "decision output")
#: Source text by kind, for good rows and for every fifth. The same SQL on both engines.
TEXTS = {
    "boolean": ("'TRUE'", "event_type"), "short": ("' ' || (event_id % 100)", "'70000'"), "integer": ("cast(event_id AS varchar(20))", "'3000000000'"), "long": ("' 30' || event_id || ' '", "event_type"),
    "double": ("event_id || '.5'", "'1,5'"), "date": ("'2024-01-02 03:04:' || (10 + event_id % 50)", "'soon'"), "json": ("props", "props || '}'"), "xml": ("'<a>' || event_type || '</a>'", "'<a>' || event_type"), "object": ("props", "event_type"),
}
SOURCE = "CASE " + " ".join(f"WHEN event_id % 13 = {KINDS.index(k)} AND event_id % 5 <> 0 THEN {good} WHEN event_id % 13 = {KINDS.index(k)} THEN {bad}" for k, (good, bad) in TEXTS.items()) + " ELSE event_type END"


def _shout(row: dict) -> str:
    if row["value"] == "view":
        raise ValueError(f"{row['name']} must not be viewed")
    return row["value"] + "?"


def variable_plugins(spark: SparkSession, d: str) -> DataFrame:
    """Events as variables of all kinds: built-in interceptors, one for decisions only, one in Python that raises, one off."""
    chain = P.variables()
    chain.add(P.VariableInterceptor("mark", lambda c: F.concat(c["value"], F.lit("!")), entities=("decision variable",), order=500))
    chain.add(P.VariableInterceptor("shout", types=("string",), entities=("runtime variable", "process variable"), order=600, python=_shout))
    chain.add(P.VariableInterceptor("off", lambda c: F.lit("never"), order=700))
    chain.configure("off", enabled=False)
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    rows = spread(table(spark, d, "events"), 50_000).selectExpr("*", f"{SOURCE} AS source")
    origin = F.when(F.col("event_id") % 4 == 0, "runtime").otherwise("history")
    name = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    done = P.run_variables(rows.select("event_id", P.context(name, at(KINDS, 13), F.col("source"), origin, at(OWNERS, 4)).alias("context")), chain.ordered())
    return done.select("event_id", "context.value", F.col("context.error.interceptor").alias("interceptor"), F.col("context.error.subject").alias("subject"), F.col("context.error.message").isNotNull().alias("failed"))


VARIABLE_PLUGINS = f"""
WITH e AS (SELECT event_id, event_type, event_id % 13 AS k, event_id % 4 AS o, event_id % 5 = 0 AS bad, {SOURCE} AS source FROM events),
f AS (SELECT *, CASE WHEN bad THEN CASE k WHEN 1 THEN 'boolean' WHEN 2 THEN 'short' WHEN 3 THEN 'integer' WHEN 4 THEN 'long' WHEN 5 THEN 'double' WHEN 7 THEN 'date' WHEN 10 THEN 'json' WHEN 11 THEN 'xml' WHEN 12 THEN 'json' END END AS broken,
  CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN lower(source) WHEN k IN (2, 3, 4, 5) THEN trim(source) WHEN k = 7 THEN replace(source, ' ', 'T') WHEN k IN (8, 9) THEN base64(encode(source)) ELSE source END AS plain FROM e),
g AS (SELECT *, CASE WHEN broken IS NOT NULL THEN broken WHEN k = 6 AND o < 2 AND event_type = 'view' THEN 'shout' END AS interceptor FROM f)
SELECT event_id, CASE WHEN broken IS NOT NULL THEN NULL WHEN interceptor = 'shout' THEN plain WHEN o >= 2 THEN plain || '!' WHEN k = 6 THEN plain || '?' ELSE plain END AS value,
  interceptor, CASE WHEN interceptor IS NOT NULL THEN 'v' || event_id END AS subject, interceptor IS NOT NULL AS failed FROM g"""


def entity_plugins(spark: SparkSession, d: str) -> DataFrame:
    """Orders as instances, line items as their tasks, parts as definitions; parents come first, and what lacks them stays."""
    def rows(name: str, kind: str, key: str, entity: dict[str, str]) -> DataFrame:
        pairs = [x for k, v in entity.items() for x in (F.lit(k), F.expr(v).cast("string"))]
        return table(spark, d, name).select(F.expr(key).alias("id"), F.lit(kind).alias("kind"), F.create_map(*pairs).alias("entity"))

    all_ = (
        rows("orders", "process instance", "concat('o', o_orderkey)", {"state": "o_orderstatus", "definition_id": "concat('p', o_custkey)", "root_key": "IF(o_custkey % 10 = 0, null, o_orderkey)", "tenant": "IF(o_custkey % 3 = 0, 'blue', '')"})
        .unionByName(rows("part", "process definition", "concat('p', p_partkey)", {"name": "p_name", "version": "p_size", "root_key": "'unused'"}))
        .unionByName(rows("supplier", "user task", "concat('s', s_suppkey)", {"name": "s_name", "instance_key": "s_suppkey"}))
    )
    chain = P.entities()
    chain.configure("user task", enabled=False)
    chain.add(P.EntityInterceptor("root", parents=lambda e, t: {"parent_key": F.concat(F.lit("of "), t["root_key"])}, types=("process instance",), order=20, parents_fail=lambda e, t: F.when(t["root_key"].isNull(), "no root")))
    chain.add(P.EntityInterceptor("state", lambda e, t: {"state": F.lower(t["state"])}, types=("running",), order=30, fails=lambda e, t: F.when(t["state"] == "P", "pending")))
    chain.add(P.EntityInterceptor("all", lambda e, t: {"end": F.coalesce(t["state"], F.lit("-"))}, order=40))
    tree = {"process instance": ("running",), "user task": ("running",)}
    done = P.convert_entities(P.preset_parents(P.begin(all_, P.TARGET), chain.ordered(), tree), chain.ordered(), tree)
    return done.select("id", *(F.col(f"target.{f}").alias(f) for f in ("tenant", "definition_id", "name", "version", "end", "state", "root_key", "parent_key")), F.col("error.interceptor").alias("interceptor"), F.col("error.message").alias("message"))


ENTITY_PLUGINS = """
WITH o AS (SELECT *, o_custkey % 10 = 0 AS lost, o_orderstatus = 'P' AS waits FROM orders)
SELECT 'o' || o_orderkey AS id, CASE WHEN lost THEN NULL WHEN o_custkey % 3 = 0 THEN 'blue' ELSE '<default>' END AS tenant, CASE WHEN NOT lost THEN 'c7-legacy-p' || o_custkey END AS definition_id, NULL AS name, NULL AS version,
  CASE WHEN NOT lost AND NOT waits THEN lower(o_orderstatus) END AS end, CASE WHEN lost THEN NULL WHEN waits THEN 'P' ELSE lower(o_orderstatus) END AS state, CASE WHEN NOT lost THEN o_orderkey::VARCHAR END AS root_key,
  CASE WHEN NOT lost THEN 'of ' || o_orderkey END AS parent_key, CASE WHEN lost THEN 'root' WHEN waits THEN 'state' END AS interceptor, CASE WHEN lost THEN 'no root' WHEN waits THEN 'pending' END AS message FROM o
UNION ALL SELECT 'p' || p_partkey, '<default>', NULL, p_name, p_size::VARCHAR, '-', NULL, NULL, NULL, NULL, NULL FROM part
UNION ALL SELECT 's' || s_suppkey, NULL, NULL, NULL, NULL, '-', NULL, NULL, NULL, NULL, NULL FROM supplier"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (variable_plugins, entity_plugins)}


def oracle_sql() -> dict[str, str]:
    return {"variable_plugins": VARIABLE_PLUGINS, "entity_plugins": ENTITY_PLUGINS}
