"""The 13 pipelines of history, with stand-in sources, and their oracles.

Each query runs its type after the types that it depends on, from a ledger that knows every fifth process instance and every
fourth decision instance as moved, and returns the ledger's rows of its type.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions.scalars import key_encode
from ferrylake.operators import pipeline as P
from ferrylake.operators.pipeline import Parent, Pipeline, Rule
from ferrylake.operators.ledger_table import LedgerTable
from ferrylake.operators.resolve import find_one
from ferrylake.schemas import HISTORY_TYPES, LEDGER
from ferrylake.sources.scans import table
from ferrylake.sources.staging import shared_dir

INSTANCE = Parent("instance", "instance", "process instance", "instance missing")
DEFINITION = Parent("definition", "definition", "process definition", "definition missing")

SPECS = {
    s.kind: s
    for s in (
        Pipeline("form definition", "id"),
        Pipeline("process definition", "id", checks=(Parent("form", "form", "form definition", "form missing", "form IS NOT NULL"),)),
        Pipeline("process instance", "id", "started", (DEFINITION, Parent("parent", "parent", "process instance", "parent instance missing", "parent IS NOT NULL")), partition_of="parent"),
        Pipeline("flow node", "id", "started", (INSTANCE,), ("started", "id"), "instance"),
        Pipeline("user task", "id", "started", (
            Rule("kind = 'view'", "standalone tasks are not supported"), Rule("kind = 'signup'", "case tasks are not supported"), INSTANCE,
            Parent("node", "node", "flow node", "flow node missing"), Parent("form", "form", "form definition", "form missing", "value > 50"),
        ), partition_of="instance"),
        Pipeline("variable", "id", "started", (
            INSTANCE, Parent("task", "task", "user task", "its task did not move", "task IS NOT NULL"), Parent("node", "node", "flow node", "scope key missing", "task IS NULL"),
        ), partition_of="instance"),
        Pipeline("job", "id", "at", (
            Rule("kind NOT IN ('click', 'purchase')", "only asynchronous jobs move"), DEFINITION, INSTANCE, Parent("root", "root", "process instance", "root instance missing"),
            Rule("outcome = 'ambiguous'", "flow node is ambiguous"), Parent("node", "node", "flow node", "flow node missing"),
        ), ("at", "log"), "root"),
        Pipeline("external task", "id", "at", (INSTANCE,), ("at", "log"), "instance"),
        Pipeline("incident", "id", checks=(INSTANCE, Parent("job", "job", "job", "job reference missing", "job IS NOT NULL")), partition_of="instance"),
        Pipeline("decision requirements", "id"),
        Pipeline("decision definition", "id", checks=(Parent("requirements", "requirements", "decision requirements", "requirements missing", "requirements IS NOT NULL"),)),
        Pipeline("decision instance", "id", "started", (
            Parent("definition", "definition", "decision definition", "decision definition missing"), Parent("root", "root", "decision instance", "root decision missing", "root IS NOT NULL"),
        )),
        Pipeline("audit log", "id", checks=(Rule("kind = 'assistant'", "operation is not supported"), INSTANCE), partition_of="instance"),
    )
}

#: Types that a type's rows refer to, directly.
NEEDS = {k: {p.kind for p in s.parents()} - {k} for k, s in SPECS.items()}


def sources(spark: SparkSession, d: str) -> dict[str, Callable[[], DataFrame]]:
    """The stand-ins of all types, each made when it is wanted."""
    t = lambda name: table(spark, d, name)
    logs = lambda: t("events").selectExpr("user_id AS id", "event_id AS log", "ts AS at", "event_type AS kind", "user_id % 150 + 1 AS definition", "user_id AS instance", "user_id + 1 AS root")

    def jobs() -> DataFrame:
        nodes = t("lineitem").where("l_quantity > 25").selectExpr("l_orderkey AS instance", "l_orderkey * 10 + l_linenumber AS node").distinct()
        return find_one(logs(), nodes, ["instance"], "node")

    return {
        "form definition": lambda: t("part").selectExpr("p_partkey AS id"),
        "process definition": lambda: t("supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 40 END AS form"),
        "process instance": lambda: t("orders").selectExpr("o_orderkey AS id", "o_orderdate AS started", "o_custkey % 150 + 1 AS definition", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey - 1 END AS parent"),
        "flow node": lambda: t("lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_shipdate AS started", "l_orderkey AS instance"),
        "user task": lambda: t("events").selectExpr("event_id AS id", "ts AS started", "event_type AS kind", "value", "event_id AS instance", "event_id * 10 + 1 AS node", "user_id AS form"),
        "variable": lambda: t("events").selectExpr("event_id AS id", "ts AS started", "event_id AS instance", "CASE WHEN event_id % 2 = 0 THEN event_id END AS task", "event_id * 10 + 2 AS node"),
        "job": jobs,
        "external task": logs,
        "incident": lambda: t("customer").selectExpr("c_custkey AS id", "c_custkey AS instance", "CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS job"),
        "decision requirements": lambda: t("nation").selectExpr("n_nationkey AS id"),
        "decision definition": lambda: t("customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey + c_custkey % 2 * 20 END AS requirements"),
        "decision instance": lambda: t("orders").selectExpr("o_orderkey AS id", "o_orderdate AS started", "o_custkey AS definition", "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - 1 END AS root"),
        "audit log": lambda: t("conversations").selectExpr("conv_id * 1000 + turn AS id", "role AS kind", "conv_id AS instance"),
    }


def first_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What moved before: some process instances and decision instances."""
    o = table(spark, d, "orders")
    key = key_encode(F.col("o_orderkey")).cast("string").alias("tgt_key")
    def of(kind: str, some: str) -> DataFrame:
        return o.where(some).select(F.col("o_orderkey").cast("string").alias("src_id"), key, F.lit(kind).alias("type"), F.col("o_orderdate").alias("create_time"), F.lit(None).cast("string").alias("skip_reason"), F.lit(7).alias("partition_id"))

    rows = of("process instance", "o_orderkey % 5 = 3").unionByName(of("decision instance", "o_orderkey % 4 = 0"))
    return rows.select(*(f.name for f in LEDGER))


def wanted(kind: str) -> list[str]:
    """A type and all that it depends on, in order."""
    found, more = {kind}, [kind]
    while more:
        for k in NEEDS[more.pop()] - found:
            found.add(k)
            more.append(k)
    return [k for k in HISTORY_TYPES if k in found]


def history(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        kinds, made = wanted(kind), sources(spark, d)
        ledger = LedgerTable.of(first_ledger(spark, d), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
        P.run({k: made[k]() for k in kinds}, ledger, [SPECS[k] for k in kinds], counter=lambda x: x.cast("long"), drawn=F.pmod(F.col("id"), F.lit(3)) + 1)
        return ledger.read(kind).select("src_id", "tgt_key", "skip_reason", "partition_id")

    query.__name__ = "history_" + kind.replace(" ", "_")
    return query


#: One relation a type in plain SQL: id, reason (r), partition (p). M1 to M13 hold those that moved.
_SQL = (
    "SELECT p_partkey AS id, NULL AS r, NULL AS p FROM part",
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 AND M1.id IS NULL THEN 'form missing' END AS r, NULL AS p FROM supplier LEFT JOIN M1 ON M1.id = s_suppkey * 40",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 3 THEN NULL WHEN M2.id IS NULL THEN 'definition missing' WHEN o_orderkey % 4 = 0 AND B.k IS NULL THEN 'parent instance missing' END AS r,
      CASE WHEN o_orderkey % 5 = 3 THEN 7 WHEN o_orderkey % 4 = 0 THEN B.p END AS p
      FROM orders LEFT JOIN M2 ON M2.id = o_custkey % 150 + 1 LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 3 THEN 7 ELSE o_orderkey % 3 + 1 END AS p
        FROM orders LEFT JOIN M2 ON M2.id = o_custkey % 150 + 1 WHERE o_orderkey % 5 = 3 OR M2.id IS NOT NULL) AS B ON B.k = o_orderkey - 1""",
    "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, CASE WHEN M3.id IS NULL THEN 'instance missing' END AS r, M3.p FROM lineitem LEFT JOIN M3 ON M3.id = l_orderkey",
    """SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'standalone tasks are not supported' WHEN event_type = 'signup' THEN 'case tasks are not supported' WHEN M3.id IS NULL THEN 'instance missing'
      WHEN M4.id IS NULL THEN 'flow node missing' WHEN value > 50 AND M1.id IS NULL THEN 'form missing' END AS r, M3.p
      FROM events LEFT JOIN M3 ON M3.id = event_id LEFT JOIN M4 ON M4.id = event_id * 10 + 1 LEFT JOIN M1 ON M1.id = user_id""",
    """SELECT event_id AS id, CASE WHEN M3.id IS NULL THEN 'instance missing' WHEN event_id % 2 = 0 AND M5.id IS NULL THEN 'its task did not move' WHEN event_id % 2 = 1 AND M4.id IS NULL THEN 'scope key missing' END AS r, M3.p
      FROM events LEFT JOIN M3 ON M3.id = event_id LEFT JOIN M5 ON M5.id = event_id LEFT JOIN M4 ON M4.id = event_id * 10 + 2""",
    """SELECT user_id AS id, CASE WHEN kind NOT IN ('click', 'purchase') THEN 'only asynchronous jobs move' WHEN M2.id IS NULL THEN 'definition missing' WHEN I.id IS NULL THEN 'instance missing' WHEN R.id IS NULL THEN 'root instance missing'
      WHEN n > 1 THEN 'flow node is ambiguous' WHEN M4.id IS NULL THEN 'flow node missing' END AS r, R.p
      FROM (SELECT user_id, arg_min(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id) LEFT JOIN M2 ON M2.id = user_id % 150 + 1 LEFT JOIN M3 AS I ON I.id = user_id LEFT JOIN M3 AS R ON R.id = user_id + 1
      LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n, min(l_linenumber) AS line FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON k = user_id LEFT JOIN M4 ON n = 1 AND M4.id = user_id * 10 + line""",
    "SELECT DISTINCT user_id AS id, CASE WHEN M3.id IS NULL THEN 'instance missing' END AS r, M3.p FROM events LEFT JOIN M3 ON M3.id = user_id",
    "SELECT c_custkey AS id, CASE WHEN M3.id IS NULL THEN 'instance missing' WHEN c_custkey % 2 = 0 AND M7.id IS NULL THEN 'job reference missing' END AS r, M3.p FROM customer LEFT JOIN M3 ON M3.id = c_custkey LEFT JOIN M7 ON M7.id = c_custkey",
    "SELECT n_nationkey AS id, NULL AS r, NULL AS p FROM nation",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 AND M10.id IS NULL THEN 'requirements missing' END AS r, NULL AS p FROM customer LEFT JOIN M10 ON M10.id = c_nationkey + c_custkey % 2 * 20",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN M11.id IS NULL THEN 'decision definition missing' WHEN o_orderkey % 2 = 1 AND B.k IS NULL THEN 'root decision missing' END AS r, CASE WHEN o_orderkey % 4 = 0 THEN 7 END AS p
      FROM orders LEFT JOIN M11 ON M11.id = o_custkey LEFT JOIN (SELECT o_orderkey AS k FROM orders LEFT JOIN M11 ON M11.id = o_custkey WHERE o_orderkey % 4 = 0 OR (o_orderkey % 2 = 0 AND M11.id IS NOT NULL)) AS B ON B.k = o_orderkey - 1""",
    "SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'assistant' THEN 'operation is not supported' WHEN M3.id IS NULL THEN 'instance missing' END AS r, M3.p FROM conversations LEFT JOIN M3 ON M3.id = conv_id",
)


def oracle(kind: str) -> str:
    parts = []
    for k in wanted(kind):
        i = HISTORY_TYPES.index(k)
        parts.append(f"H{i + 1} AS ({_SQL[i]}), M{i + 1} AS (SELECT id, coalesce(p, id % 3 + 1)::INTEGER AS p FROM H{i + 1} WHERE r IS NULL)")
    i = HISTORY_TYPES.index(kind) + 1
    return f"""WITH {", ".join(parts)} SELECT id::VARCHAR AS src_id, CASE WHEN r IS NULL THEN (4095::BIGINT * 2251799813685248 + id)::VARCHAR END AS tgt_key, r AS skip_reason,
      CASE WHEN r IS NULL THEN coalesce(p, id % 3 + 1)::INTEGER END AS partition_id FROM H{i}"""


#: Instances whose parents and roots are of their own type: chains of 40 orders, of which some have no definition.
CHAIN = Pipeline(
    "process instance", "id", "started", (
        Rule("status = 'P'", "is still pending"), Parent("parent", "parent", "process instance", "parent instance missing", "parent IS NOT NULL"), Parent("root", "root", "process instance", "root instance missing", "root IS NOT NULL"),
    ), partition_of="parent",
)


def chain_source(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_orderdate").alias("started"), F.col("o_orderstatus").alias("status"), F.when(k % 40 != 1, k - 1).alias("parent"), F.when(k % 40 != 1, k - F.pmod(k - 1, F.lit(40))).alias("root"))


def history_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chains of parents of one type, moved in one run: each row with its reason, partition, and its parents' keys."""
    how = {"counter": lambda x: x.cast("long"), "drawn": F.pmod(F.col("id"), F.lit(3)) + 1}
    rows = P.tried(chain_source(spark, d), first_ledger(spark, d).where("false"), CHAIN, **how)
    return rows.select("src_id", "tgt_key", "skip_reason", "partition_id", F.col("parents.parent").alias("parent_key"), F.col("parents.root").alias("root_key"))


HISTORY_CHAIN = """
WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_orderstatus AS s, CASE WHEN o_orderkey % 40 <> 1 THEN o_orderkey - 1 END AS parent, CASE WHEN o_orderkey % 40 <> 1 THEN o_orderkey - ((o_orderkey - 1) % 40 + 40) % 40 END AS root FROM orders),
up AS (SELECT id, id AS root, id % 3 + 1 AS p FROM o WHERE s <> 'P' AND parent IS NULL UNION ALL SELECT o.id, up.root, up.p FROM up JOIN o ON o.parent = up.id WHERE o.s <> 'P'),
k AS (SELECT id, p, (4095::BIGINT * 2251799813685248 + id)::VARCHAR AS key FROM up)
SELECT o.id::VARCHAR AS src_id, CASE WHEN m.id IS NOT NULL THEN m.key END AS tgt_key, CASE WHEN s = 'P' THEN 'is still pending' WHEN parent IS NOT NULL AND pk.id IS NULL THEN 'parent instance missing' WHEN root IS NOT NULL AND rk.id IS NULL THEN 'root instance missing' END AS skip_reason,
  m.p::INTEGER AS partition_id, pk.key AS parent_key, rk.key AS root_key
FROM o LEFT JOIN k AS m ON m.id = o.id LEFT JOIN k AS pk ON pk.id = o.parent LEFT JOIN k AS rk ON rk.id = o.root"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in map(history, HISTORY_TYPES)} | {"history_chain": history_chain}


def oracle_sql() -> dict[str, str]:
    return {"history_" + k.replace(" ", "_"): oracle(k) for k in HISTORY_TYPES} | {"history_chain": HISTORY_CHAIN}
