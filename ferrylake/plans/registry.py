"""All driver queries of the library proper, with their oracles.

Stand-ins: orders are instances, line items their children, customers owners, nations and regions parents, events logs,
conversations nested messages, pages endpoints. The ledger L knows an order as moved if its key is no multiple of ten, as
skipped if it is one of thirty, and not at all otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions import scalars as S
from ferrylake.functions.interceptors import Interceptor, Registry, supports
from ferrylake.operators import apimap, findings, identity, ledger, resolve, tree
from ferrylake.plans import details, diagrams, history, plugged, resumed, timed, trees
from ferrylake.sources import scans
from ferrylake.sources.scans import table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle.strip()
        return f

    return add


def queries() -> dict[str, Query]:
    return _queries | history.queries() | diagrams.queries() | timed.queries() | trees.queries() | plugged.queries() | details.queries() | resumed.queries()


def oracle_sql() -> dict[str, str]:
    return _oracles | history.oracle_sql() | diagrams.oracle_sql() | timed.oracle_sql() | trees.oracle_sql() | plugged.oracle_sql() | details.oracle_sql() | resumed.oracle_sql()


def L(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of orders, derived from their keys."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    moved = key % 10 != 0
    return o.where(moved | (key % 3 == 0)).select(
        key.cast("string").alias("src_id"), F.when(moved, S.key_encode(key)).cast("string").alias("tgt_key"), F.lit("order").alias("type"),
        F.col("o_orderdate").alias("create_time"), F.when(~moved, "owner missing").alias("skip_reason"), (key % 3 + 1).cast("int").alias("partition_id"),
    )


def ledger_all(spark: SparkSession, d: str) -> DataFrame:
    """L and like rows for customers and suppliers."""
    def other(name: str, key: str, kind: str) -> DataFrame:
        k = F.col(key)
        moved = k % 4 != 0
        return table(spark, d, name).where(moved | (k % 3 == 0)).select(k.cast("string").alias("src_id"), F.when(moved, k).cast("string").alias("tgt_key"), F.lit(kind).alias("type"), F.lit(None).cast("timestamp_ntz").alias("create_time"), F.lit(None).cast("string").alias("skip_reason"), F.lit(1).alias("partition_id"))

    return L(spark, d).unionByName(other("customer", "c_custkey", "customer")).unionByName(other("supplier", "s_suppkey", "supplier"))


KEY_SQL = "(4095::BIGINT * 2251799813685248 + {})"
L_SQL = f"""L AS (SELECT o_orderkey::VARCHAR AS src_id, CASE WHEN o_orderkey % 10 <> 0 THEN {KEY_SQL.format("o_orderkey")}::VARCHAR END AS tgt_key, 'order' AS type,
  o_orderdate AS create_time, (o_orderkey % 3 + 1)::INTEGER AS partition_id FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 3 = 0)"""
ALL_SQL = f"""{L_SQL}, A AS (SELECT src_id, tgt_key, type, create_time FROM L
  UNION ALL SELECT c_custkey::VARCHAR, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::VARCHAR END, 'customer', NULL FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 3 = 0
  UNION ALL SELECT s_suppkey::VARCHAR, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey::VARCHAR END, 'supplier', NULL FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 3 = 0)"""


def orders_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("src_id", F.col("o_orderkey").cast("string"))


# --- the flagship: what is still to move, and why are rows blocked? ---------------------------------------------------


@query("""
    WITH P AS (SELECT * FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 3 <> 0),
    R AS (SELECT CASE WHEN c_custkey IS NULL THEN 'owner missing' WHEN n_nationkey IS NULL THEN 'parent missing' WHEN c_acctbal < 0 THEN 'owner blocked' ELSE 'ok' END AS outcome
      FROM P LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT outcome, count(*) AS n FROM R GROUP BY outcome""")
def entry_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.pending(orders_by_id(spark, d).select("src_id", "o_custkey"), L(spark, d), "src_id", "order")
    owner = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nation = table(spark, d, "nation").select("n_nationkey")
    joined = rows.join(owner, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    reason = resolve.first_reason([(F.col("c_custkey").isNull(), "owner missing"), (F.col("n_nationkey").isNull(), "parent missing"), (F.col("c_acctbal") < 0, "owner blocked")])
    return joined.groupBy(F.coalesce(reason, F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


# --- scans -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 3 = 0) AS l WHERE k = o_orderkey)")
def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    return ledger.pending(orders_by_id(spark, d).select("src_id", "o_orderkey", "o_orderdate"), L(spark, d), "src_id", "order").drop("src_id")


@query(f"WITH {L_SQL} SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(create_time) FROM L WHERE create_time < TIMESTAMP '1997-01-01') ORDER BY o_orderdate, o_orderkey")
def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    after = L(spark, d).where("create_time < timestamp_ntz'1997-01-01'").agg(F.max("create_time")).first()[0]
    return scans.incremental(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", after)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 AND o_orderdate > TIMESTAMP '1996-06-01'")
def root_unfinished(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    parent = F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey"))
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return scans.root_unfinished(table(spark, d, "orders"), "o_orderdate", "o_orderkey", parent, end, datetime(1996, 6, 1))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 40")
def keyset_by_id(spark: SparkSession, d: str) -> DataFrame:
    return scans.keyset(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 40)


@query(f"WITH {L_SQL} SELECT src_id, EXISTS (SELECT 1 FROM orders WHERE o_orderkey::VARCHAR = src_id AND o_orderkey % 7 <> 0) AS present FROM L WHERE tgt_key IS NULL")
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    return ledger.retry_queue(L(spark, d), orders_by_id(spark, d).where("o_orderkey % 7 <> 0"), "src_id", "order")


@query("SELECT p_partkey, p_name, (SELECT greatest(1, ceil(count(*) / 10))::BIGINT FROM part) AS pages FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 20)")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return scans.offset_page(part, ["p_partkey"], 2, 10).join(F.broadcast(scans.page_count(part, 10)))  # one row


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def membership_scan(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    named = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return scans.members(users.select("s_suppkey", "s_name"), users, "s_suppkey", "s_nationkey").join(named, "s_nationkey").select("s_suppkey", "s_name", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey < 20)")
def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return scans.lookup(o.select("o_orderkey", "o_totalprice"), o.where("o_custkey < 20"), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def finished_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%/en/%' THEN 'process' WHEN lower(url) LIKE '%/de/%' THEN 'decision' END AS kind FROM pages")
def suffix_dispatch(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("file"), F.when(F.lower("url").contains("/en/"), ".bpmn20.xml").when(F.lower("url").contains("/de/"), ".DMN").otherwise(".txt"))
    return table(spark, d, "pages").select("page_id", S.file_kind(name).alias("kind"))


# --- ledger ------------------------------------------------------------------------------------------------------------


@query(f"WITH {ALL_SQL} SELECT count(*) FILTER (tgt_key IS NULL) AS n FROM A")
def count_skipped(spark: SparkSession, d: str) -> DataFrame:
    return ledger_all(spark, d).agg(F.count_if(ledger.is_skipped()).alias("n"))


@query(f"WITH {ALL_SQL} SELECT type, count(*) FILTER (tgt_key IS NULL) AS skipped, count(*) FILTER (tgt_key IS NOT NULL) AS moved FROM A GROUP BY type")
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ledger.counts(ledger_all(spark, d))


@query(f"WITH {ALL_SQL} SELECT type, max(create_time) AS latest_time FROM A GROUP BY type")
def latest_time(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(ledger_all(spark, d)).select("type", "latest_time")


@query(f"WITH {ALL_SQL} SELECT type, max(src_id) AS latest_id FROM A GROUP BY type")
def latest_id(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(ledger_all(spark, d)).select("type", "latest_id")


@query(f"""WITH {L_SQL} SELECT o_orderkey, src_id IS NOT NULL AS known, tgt_key IS NOT NULL AS moved,
      EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS waiting FROM orders LEFT JOIN L ON src_id = o_orderkey::VARCHAR""")
def exists_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.with_state(orders_by_id(spark, d).select("src_id", "o_orderkey"), L(spark, d), "src_id", "order")
    waiting = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("w", F.lit(True))
    return rows.join(waiting, "o_orderkey", "left").select("o_orderkey", (F.col("state") != "absent").alias("known"), (F.col("state") == "moved").alias("moved"), F.coalesce("w", F.lit(False)).alias("waiting"))


@query(f"WITH {L_SQL} SELECT l_orderkey, l_linenumber, tgt_key::BIGINT AS tgt_key FROM lineitem LEFT JOIN L ON src_id = l_orderkey::VARCHAR")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("src_id"), "l_orderkey", "l_linenumber")
    return ledger.with_state(rows, L(spark, d), "src_id", "order").select("l_orderkey", "l_linenumber", "tgt_key")


@query(f"""WITH {L_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN (l_orderkey % 3 + 1)::INTEGER ELSE partition_id END AS partition_id
    FROM lineitem LEFT JOIN L ON src_id = l_orderkey::VARCHAR AND tgt_key IS NOT NULL""")
def partition_inherit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 1, F.col("l_orderkey").cast("string")).alias("root"))
    drawn = (F.col("l_orderkey") % 3 + 1).cast("int")
    return resolve.inherit_partition(rows, L(spark, d), "root", "order", drawn).select("l_orderkey", "l_linenumber", "partition_id")


@query(f"""WITH {L_SQL} SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'start' WHEN src_id IS NULL THEN 'insert skipped' ELSE 'update reason' END AS action,
    src_id IS NULL AS may_start FROM orders LEFT JOIN L ON src_id = o_orderkey::VARCHAR""")
def route_action(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.with_state(orders_by_id(spark, d).select("src_id", "o_orderkey", "o_totalprice"), L(spark, d), "src_id", "order")
    reason = F.when(~(F.col("o_totalprice") > 1000), "too small")
    return rows.select("o_orderkey", ledger.route(F.col("state"), reason).alias("action"), ledger.may_start(F.col("state"), "migrate").alias("may_start"))


@query(f"""WITH {L_SQL}, D AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 4 = 0 THEN '7' END AS k, o_orderdate, CASE WHEN o_orderkey % 4 <> 0 THEN 'still blocked' END AS r, 9 AS p
      FROM orders WHERE o_orderkey % 10 = 0)
    SELECT coalesce(src_id, id) AS src_id, coalesce(tgt_key, k) AS tgt_key,
      CASE WHEN tgt_key IS NOT NULL THEN NULL WHEN id IS NULL THEN 'owner missing' WHEN k IS NOT NULL THEN NULL WHEN src_id IS NULL THEN r ELSE r END AS skip_reason,
      CASE WHEN tgt_key IS NOT NULL THEN partition_id WHEN k IS NOT NULL OR src_id IS NULL THEN coalesce(p, partition_id) ELSE partition_id END AS partition_id
    FROM L FULL JOIN D ON id = src_id""")
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    delta = table(spark, d, "orders").where(k % 10 == 0).select(k.cast("string").alias("src_id"), F.lit("order").alias("type"), F.when(k % 4 == 0, "7").alias("tgt_key"), F.col("o_orderdate").alias("create_time"), F.when(k % 4 != 0, "still blocked").alias("skip_reason"), F.lit(9).alias("partition_id"))
    return ledger.upsert(L(spark, d), delta, save_reason=True).select("src_id", "tgt_key", "skip_reason", "partition_id")


@query(f"WITH {L_SQL} SELECT src_id FROM L WHERE src_id::BIGINT % 5 <> 0")
def ledger_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = orders_by_id(spark, d).where("o_orderkey % 5 = 0").select("src_id")
    return ledger.delete(L(spark, d), gone).select("src_id")


# --- parents, reasons, first and latest ----------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL OR p_size > 45 THEN 'definition missing' WHEN o_orderkey IS NULL OR o_orderkey % 10 = 0 THEN 'instance missing'
      WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'root missing' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'tenant not allowed' END AS reason
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
def skip_reason_first(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("has_definition"))
    order = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.lit(True).alias("has_instance"))
    owner = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(True).alias("has_root"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey", "left").join(order, "l_orderkey", "left").join(owner, "o_custkey", "left")
    rules: list[tuple[Column, str | Column]] = [(F.col(f"has_{n}").isNull(), f"{n} missing") for n in ("definition", "instance", "root")]
    rules.append((~F.coalesce(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit(False)), "tenant not allowed"))
    return rows.select("l_orderkey", "l_linenumber", resolve.first_reason(rules).alias("reason"))


@query("""WITH R AS (SELECT *, CASE WHEN l_quantity > 45 THEN 'multi-instance' WHEN l_returnflag = 'R' THEN 'gateway' WHEN l_linestatus = 'F' THEN 'not in target' END AS r FROM lineitem)
    SELECT l_orderkey, arg_min(r, (l_linenumber, l_partkey, l_suppkey, l_quantity)) FILTER (r IS NOT NULL) AS reason FROM R GROUP BY l_orderkey""")
def validate_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    rules = [(F.col("l_quantity") > 45, "multi-instance"), (F.col("l_returnflag") == "R", "gateway"), (F.col("l_linestatus") == "F", "not in target")]
    return resolve.first_failure(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], rules)


@query("""WITH C AS (SELECT l_suppkey, l_linenumber, count(*) AS n, min(l_orderkey) AS v FROM lineitem WHERE l_quantity > 49 GROUP BY ALL)
    SELECT s_suppkey, v_line AS l_linenumber, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN n = 1 THEN v END AS l_orderkey
    FROM supplier CROSS JOIN (VALUES (1), (2), (3)) AS t(v_line) LEFT JOIN C ON l_suppkey = s_suppkey AND l_linenumber = v_line""")
def find_one_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("l_linenumber"))
    lines = table(spark, d, "lineitem").where("l_quantity > 49").select("l_suppkey", "l_linenumber", "l_orderkey")
    return resolve.find_one(rows, lines, ["l_suppkey", "l_linenumber"], "l_orderkey").withColumnRenamed("l_suppkey", "s_suppkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_missing_node(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(seen, "p_partkey", "left_anti")


@query("""WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 AND n_nationkey % 7 <> 0),
    c AS (SELECT c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey WHERE c_acctbal >= 0), o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0),
    l AS (SELECT l_orderkey FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_quantity < 40)
    SELECT * FROM (VALUES ('region', (SELECT count(*) FROM region WHERE r_regionkey <> 2)), ('nation', (SELECT count(*) FROM n)), ('customer', (SELECT count(*) FROM c)), ('orders', (SELECT count(*) FROM o)), ('lineitem', (SELECT count(*) FROM l))) AS t(level, moved)""")
def fixpoint_retry(spark: SparkSession, d: str) -> DataFrame:
    """One pass in the order of dependencies resolves all types: a row moves if it may and its parent moved."""
    levels = [("region", "r_regionkey", None, "r_regionkey <> 2"), ("nation", "n_nationkey", "n_regionkey", "n_nationkey % 7 <> 0"), ("customer", "c_custkey", "c_nationkey", "c_acctbal >= 0"), ("orders", "o_orderkey", "o_custkey", "o_orderkey % 10 <> 0"), ("lineitem", "l_orderkey", "l_orderkey", "l_quantity < 40")]
    moved, out = None, None
    for name, key, parent, allowed in levels:
        rows = table(spark, d, name).where(allowed)
        if parent:
            rows = rows.join(moved, rows[parent] == moved["key"], "left_semi")
        moved = rows.select(F.col(key).alias("key"))
        n = moved.agg(F.count("*").alias("moved")).select(F.lit(name).alias("level"), "moved")
        out = n if out is None else out.unionByName(n)
    return out


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS id, c_custkey // 3 AS parent, c_custkey % 11 <> 0 AS ok FROM customer),
    m AS (SELECT id FROM e WHERE ok AND parent NOT IN (SELECT id FROM e) UNION ALL SELECT e.id FROM e JOIN m ON e.parent = m.id WHERE e.ok)
    SELECT id, id IN (SELECT id FROM m) AS moved FROM e""")
def fixpoint_chain(spark: SparkSession, d: str) -> DataFrame:
    """Parents of the same type, retried until no more rows move."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 3).alias("parent"), (F.col("c_custkey") % 11 != 0).alias("ok"), F.lit(None).cast("string").alias("tgt_key"))
    ids = rows.select(F.col("id").alias("parent"), F.lit(True).alias("has_parent"))

    def step(state: DataFrame) -> DataFrame:
        parents = state.select(F.col("id").alias("parent"), F.col("tgt_key").alias("parent_key"))
        now = state.join(parents, "parent", "left")
        may = F.col("ok") & (F.col("parent_key").isNotNull() | ~F.col("has_parent"))
        return now.withColumn("tgt_key", F.coalesce("tgt_key", F.when(may, F.col("id").cast("string")))).select(*state.columns)

    start = rows.join(ids, "parent", "left").withColumn("has_parent", F.coalesce("has_parent", F.lit(False)))
    return resolve.retry_to_fixpoint(start, step).select("id", F.col("tgt_key").isNotNull().alias("moved"))


@query("SELECT user_id, min(event_id) FILTER (rn = 1) AS event_id, min(event_type) FILTER (rn = 1) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY user_id")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return resolve.first_by(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, min(event_id) FILTER (rn = 1) AS event_id, min(ts) FILTER (rn = 1) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return resolve.latest_by(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return resolve.latest_by(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT user_id AS scope, event_type AS name, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def variable_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("name"), "value", "ts", "event_id")
    return resolve.ordered_map(rows, "scope", "name", "value", ["ts", "event_id"])


@query("SELECT DISTINCT l_linenumber AS partition_id FROM lineitem")
def distinct_partitions(spark: SparkSession, d: str) -> DataFrame:
    brokers = table(spark, d, "lineitem").select(F.array("l_linenumber").alias("partitions"))
    return scans.topology_partitions(brokers, "partitions")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def root_group(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nation = table(spark, d, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey").drop("c_nationkey")


@query("SELECT a.l_orderkey, a.l_linenumber, min(b.l_linenumber) AS parent FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber - 1 GROUP BY ALL")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    parents = lines.select("l_orderkey", F.col("l_linenumber").alias("parent"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    return lines.join(parents, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, coalesce(o_orderstatus, 'Unknown') AS status, coalesce(c_name, 'Unknown') AS owner FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_sentinel(spark: SparkSession, d: str) -> DataFrame:
    order = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey")
    owner = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(order, "l_orderkey", "left").join(owner, "o_custkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("o_orderstatus", F.lit("Unknown")).alias("status"), F.coalesce("c_name", F.lit("Unknown")).alias("owner"))


# --- findings --------------------------------------------------------------------------------------------------------------


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as messages: every third turn has none, severities by the turn's number."""
    sev = F.element_at(F.array(*map(F.lit, ("REVIEW", "TASK", "INFO", "WARNING", "OTHER"))), ((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("int") + 1)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", sev.alias("severity"), F.col("text").alias("message"))


M_SQL = "M AS (SELECT conv_id, turn, role, ['REVIEW', 'TASK', 'INFO', 'WARNING', 'OTHER'][((turn * 7 + conv_id) % 5 + 1)::INTEGER] AS severity, text AS message FROM conversations)"


@query(f"WITH {M_SQL} SELECT conv_id::VARCHAR AS filename, turn::VARCHAR AS element_id, severity, message FROM M WHERE turn % 3 <> 0")
def findings_flatten(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    message = F.struct("severity", F.col("severity").alias("id"), "message", F.lit(None).cast("string").alias("link"))
    per_turn = F.when(F.col("turn") % 3 != 0, F.array(message)).otherwise(F.array().cast("array<struct<severity:string,id:string,message:string,link:string>>"))
    element = F.struct(F.col("turn").cast("string").alias("element_id"), F.col("role").alias("element_name"), F.col("role").alias("element_type"), per_turn.alias("messages"))
    nested = m.groupBy(F.col("conv_id").cast("string").alias("filename")).agg(F.collect_list(element).alias("results"))
    return findings.flatten(nested).select("filename", "element_id", "severity", "message")


@query(f"WITH {M_SQL}, F AS (SELECT role AS element, min(conv_id * 1000 + turn) AS ordinal FROM M GROUP BY role) SELECT element, ordinal, severity, n FROM F LEFT JOIN (SELECT role, severity, count(*) AS n FROM M GROUP BY ALL) ON element = role")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    elements = m.select(F.col("role").alias("element"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"))
    return findings.first_match(elements, m.groupBy(F.col("role").alias("element"), "severity").agg(F.count("*").alias("n")))


@query(f"""WITH {M_SQL}, R AS (SELECT conv_id AS element, turn AS ordinal, conv_id - turn AS target FROM M WHERE turn > 0)
    SELECT conv_id AS element, -1::BIGINT AS ordinal, turn AS position, message FROM M UNION ALL SELECT element, ordinal, M.turn, M.message FROM R JOIN M ON M.conv_id = target""")
def references_collect(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    own = m.select(F.col("conv_id").alias("element"), F.col("turn").alias("position"), "message")
    refs = m.where("turn > 0").select(F.col("conv_id").alias("element"), F.col("turn").alias("ordinal"), (F.col("conv_id") - F.col("turn")).alias("target"))
    return resolve.collect_references(own, refs).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"WITH {M_SQL} SELECT conv_id, severity, min(turn) AS first_position, count(*) AS n FROM M GROUP BY conv_id, severity")
def severity_groups(spark: SparkSession, d: str) -> DataFrame:
    return findings.severity_groups(messages(spark, d).withColumnRenamed("turn", "position"), "conv_id")


@query(f"WITH {M_SQL} SELECT conv_id, ['WARNING', 'TASK', 'REVIEW', 'INFO'][coalesce(min(CASE severity WHEN 'WARNING' THEN 1 WHEN 'TASK' THEN 2 WHEN 'REVIEW' THEN 3 WHEN 'INFO' THEN 4 END), 4)] AS severity FROM M GROUP BY conv_id")
def most_severe(spark: SparkSession, d: str) -> DataFrame:
    return findings.most_severe(messages(spark, d), "conv_id")


@query(f"WITH {M_SQL} SELECT role, sum(n)::BIGINT AS n FROM (SELECT role, conv_id, count(*) AS n FROM M GROUP BY ALL) GROUP BY role")
def total_findings(spark: SparkSession, d: str) -> DataFrame:
    by_file = messages(spark, d).groupBy("role", "conv_id").agg(F.count("*").alias("n"))
    return by_file.groupBy("role").agg(F.sum("n").alias("n"))


@query("SELECT user_id, bool_or(event_type = 'click') AS has_start, bool_and(value > 1) AS all_large, NOT bool_or(event_type = 'purchase') AS none_bought FROM events GROUP BY user_id")
def none_start_event(spark: SparkSession, d: str) -> DataFrame:
    is_click = F.col("event_type") == "click"
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(is_click).alias("has_start"), F.bool_and(F.col("value") > 1).alias("all_large"), (~F.bool_or(F.col("event_type") == "purchase")).alias("none_bought"))


@query("SELECT p_partkey, rule FROM part JOIN (VALUES ('old', NULL, 8003), ('middle', 8003, 8010), ('new', 8010, NULL), ('always', NULL, NULL)) AS r(rule, lo, hi) ON (lo IS NULL OR 8000 + p_size >= lo) AND (hi IS NULL OR 8000 + p_size < hi)")
def version_gate(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("old", None, "8.3"), ("middle", "8.3", "8.10"), ("new", "8.10", None), ("always", None, None)], "rule string, lo string, hi string")
    rules = rules.select("rule", S.version_number(F.col("lo")).alias("min_version"), S.version_number(F.col("hi")).alias("before_version"))
    parts = table(spark, d, "part").select("p_partkey", S.version_number(F.concat(F.lit("8."), F.col("p_size").cast("string"))).alias("version"))
    return findings.gate(rules, parts).select("p_partkey", "rule")


@query("SELECT p_partkey FROM (SELECT p_partkey FROM part WHERE p_size < 30 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def coverage_missing(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "part").where("p_size < 30").select("p_partkey")
    return findings.missing(expected, table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"))


# --- identity --------------------------------------------------------------------------------------------------------------


def authorizations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    perms = F.when(k % 5 == 0, F.array(F.lit("ALL"), F.lit("READ"))).when(k % 5 == 1, F.array(F.lit("NONE"))).when(k % 5 == 2, F.array(F.lit("READ"), F.lit("NONE"))).when(k % 5 == 3, F.array(F.lit("READ"), F.lit("UPDATE"))).otherwise(F.array(F.lit("READ"), F.lit("FLY")))
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 7 == 0, "REVOKE").otherwise("GRANT").alias("kind"), F.when(k % 3 == 0, "definition").otherwise("instance").alias("resource"),
        F.when(k % 4 == 0, "*").otherwise(k.cast("string")).alias("resource_id"), perms.alias("permissions"), F.when(k % 2 == 0, F.col("c_name")).otherwise(" ").alias("user_id"), F.col("c_nationkey").cast("string").alias("group_id"),
    )


A_SQL = """A AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'REVOKE' ELSE 'GRANT' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'definition' ELSE 'instance' END AS resource,
  CASE WHEN c_custkey % 4 = 0 THEN '*' ELSE c_custkey::VARCHAR END AS resource_id, c_custkey % 5 AS p, c_custkey % 2 = 0 AS is_user, c_custkey, c_nationkey FROM customer)"""


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN '' WHEN 2 THEN 'READ' WHEN 3 THEN 'READ,UPDATE' ELSE 'READ,FLY' END AS permissions FROM customer")
def perm_all(spark: SparkSession, d: str) -> DataFrame:
    return authorizations(spark, d).select("id", F.array_join(identity.dominant(F.col("permissions")), ",").alias("permissions"))


@query(f"""WITH {A_SQL}, T AS (SELECT *, CASE p WHEN 0 THEN 'create,delete,read,update' WHEN 1 THEN '' WHEN 2 THEN 'read' WHEN 3 THEN 'read,update' END AS target FROM A),
    R AS (SELECT *, CASE WHEN kind <> 'GRANT' THEN 'only grants can move' WHEN resource_id <> '*' AND resource <> 'definition' THEN 'resource type takes no explicit ids' WHEN target IS NULL THEN 'a permission has no counterpart'
      WHEN NOT (CASE WHEN is_user THEN c_custkey % 6 <> 0 ELSE c_nationkey % 2 = 0 END) THEN 'owner does not exist' END AS reason FROM T)
    SELECT id, x AS resource_id, target AS permissions, reason FROM (SELECT *, unnest(CASE WHEN reason IS NOT NULL THEN [NULL] WHEN resource_id = '*' THEN ['*'] ELSE [resource_id, 'c7-legacy-' || resource_id] END) AS x FROM R)""")
def auth_expand(spark: SparkSession, d: str) -> DataFrame:
    auth = authorizations(spark, d)
    targets = {"ALL": "read,update,create,delete", "READ": "read", "UPDATE": "update"}
    rules = spark.createDataFrame([(r, p, t.split(",")) for r in ("definition", "instance") for p, t in targets.items()], "resource string, permission string, targets array<string>")
    users = table(spark, d, "customer").where("c_custkey % 6 <> 0").select(F.col("c_name").alias("id"))
    groups = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("id"))
    rows = identity.owners(auth.join(identity.mapped_permissions(auth, rules), "id"), users, groups)
    reason = identity.authorization_reason(F.col("kind"), F.col("resource").isNotNull(), F.col("resource") == "definition", F.col("resource_id"), F.col("owner_exists"), F.col("target_permissions"))
    ids = F.when(F.col("reason").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(identity.expand_ids(F.col("resource_id")))
    return rows.withColumn("reason", reason).select("id", F.explode(ids).alias("resource_id"), F.array_join("target_permissions", ",").alias("permissions"), "reason")


@query(f"WITH {A_SQL} SELECT id, CASE WHEN is_user THEN c_custkey % 6 <> 0 ELSE c_nationkey % 2 = 0 END AS owner_exists FROM A")
def owner_exists(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").where("c_custkey % 6 <> 0").select(F.col("c_name").alias("id"))
    groups = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("id"))
    return identity.owners(authorizations(spark, d), users, groups).select("id", "owner_exists")


@query("SELECT s_nationkey AS parent, s_suppkey AS member FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1) AND s_acctbal > 0")
def membership_after_parent(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    rows = s.select(F.col("s_nationkey").alias("parent"), F.col("s_suppkey").alias("member"))
    return identity.memberships(rows, table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("parent")), s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("member"))).select("parent", "member")


# --- endpoints ---------------------------------------------------------------------------------------------------------------


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("/r"), (k % 40).cast("string"), F.when(k % 3 == 0, "/tenant-id").otherwise(""))
    return table(spark, d, "pages").select(k, path.alias("path"), F.when(k % 2 == 0, "get").otherwise("post").alias("operation"), F.concat(F.lit("s"), (k % 9).cast("string")).alias("summary"))


E_SQL = "E AS (SELECT page_id, '/r' || page_id % 40 || CASE WHEN page_id % 3 = 0 THEN '/tenant-id' ELSE '' END AS path, CASE WHEN page_id % 2 = 0 THEN 'get' ELSE 'post' END AS operation, 's' || page_id % 9 AS summary FROM pages)"


@query(f"""WITH {E_SQL}, M AS (SELECT '/r' || p_partkey % 30 AS path, CASE WHEN p_partkey % 2 = 0 THEN 'get' ELSE 'post' END AS operation, p_partkey AS ordinal, '/t' || p_size AS target_path, p_size % 10 = 0 AS discontinued FROM part),
    M1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, operation ORDER BY ordinal) AS rn FROM M) WHERE rn = 1)
    SELECT E.page_id, CASE WHEN ordinal IS NULL THEN 'to be decided' WHEN discontinued THEN 'discontinued' WHEN target_path NOT IN (SELECT '/t' || s_suppkey FROM supplier) THEN 'unknown target' ELSE 'mapped' END AS status
    FROM E LEFT JOIN M1 USING (path, operation)""")
def api_coverage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    mapping = table(spark, d, "part").select(F.concat(F.lit("/r"), (k % 30).cast("string")).alias("path"), F.when(k % 2 == 0, "get").otherwise("post").alias("operation"), k.alias("ordinal"), F.concat(F.lit("/t"), F.col("p_size").cast("string")).alias("target_path"), F.lit("any").alias("target_operation"), (F.col("p_size") % 10 == 0).alias("discontinued"))
    target = table(spark, d, "supplier").select(F.concat(F.lit("/t"), F.col("s_suppkey").cast("string")).alias("target_path"), F.lit("any").alias("target_operation"), F.col("s_name").alias("target_summary"), F.col("s_suppkey").alias("ordinal"))
    return apimap.coverage(endpoints(spark, d), mapping, target).select("page_id", "status")


@query(f"WITH {E_SQL} SELECT DISTINCT a.summary AS tag, a.path, b.operation FROM E a JOIN E b ON a.path = b.path")
def api_sections(spark: SparkSession, d: str) -> DataFrame:
    return apimap.sections(endpoints(spark, d).select("path", "operation", F.array("summary").alias("tags")))


@query(f"WITH {E_SQL} SELECT page_id, path FROM E WHERE path LIKE '%tenant-id%' AND operation = 'get' AND summary <> 's0'")
def endpoint_filter(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("summary") == "s0", "to be decided").otherwise("mapped")
    return endpoints(spark, d).where(apimap.shown(F.col("path"), F.col("operation"), status, "tenant-id", "get", hide_open=True)).select("page_id", "path")


@query(f"WITH {E_SQL} SELECT row_number() OVER (ORDER BY summary, contains(path, 'tenant-id'), page_id) AS position, page_id FROM E")
def endpoint_sort(spark: SparkSession, d: str) -> DataFrame:
    """The list as it is shown, with each endpoint's place in it."""
    rows = endpoints(spark, d).withColumn("late", F.col("path").contains("tenant-id"))
    return resolve.numbered(rows, "summary", "late", "page_id").select("position", "page_id")


# --- scalars -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {KEY_SQL.format('o_orderkey')} AS key, 4095 AS partition_id FROM orders")
def key_encode(spark: SparkSession, d: str) -> DataFrame:
    key = S.key_encode(F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", key.alias("key"), S.key_partition(key).alias("partition_id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'c7-legacy-' || c_name END AS id FROM customer")
def legacy_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.legacy_prefix(F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))).alias("id"))


@query("""SELECT p_partkey, CASE WHEN x IS NULL THEN NULL WHEN trim(x) = '' THEN 'blank' WHEN length(x) > 100 THEN 'too long' WHEN NOT regexp_full_match(x, '[A-Za-z_][A-Za-z0-9._-]*') THEN 'bad characters' END AS problem
    FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN repeat('a', 101) WHEN 3 THEN p_name WHEN 4 THEN 'ok_' || p_partkey ELSE p_partkey || 'x' END AS x FROM part)""")
def prefix_validate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = F.when(k % 6 == 1, "  ").when(k % 6 == 2, "a" * 101).when(k % 6 == 3, F.col("p_name")).when(k % 6 == 4, F.concat(F.lit("ok_"), k.cast("string"))).when(k % 6 == 5, F.concat(k.cast("string"), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", S.prefix_problem(x).alias("problem"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '<default>' END AS tenant FROM customer")
def tenant_default(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", S.tenant_default(F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, "")).alias("tenant"))


@query("SELECT p_partkey, replace(p_name || '#multiInstanceBody' || p_partkey || '#multiInstanceBody', '#multiInstanceBody', '') AS name FROM part")
def strip_suffix(spark: SparkSession, d: str) -> DataFrame:
    from ferrylake.schemas import MULTI_INSTANCE_SUFFIX

    m = F.lit(MULTI_INSTANCE_SUFFIX)
    return table(spark, d, "part").select("p_partkey", S.strip_all(F.concat("p_name", m, F.col("p_partkey").cast("string"), m), MULTI_INSTANCE_SUFFIX).alias("name"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id END::VARCHAR, 'null') AS value, event_type || ' ' || coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'null') AS name FROM events")
def stringify_null(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", S.text_of(F.when(e % 4 != 0, F.col("user_id"))).alias("value"), S.full_name(F.col("event_type"), F.when(e % 3 == 0, F.col("event_type"))).alias("name"))


_GUARDED = "CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN chr(9) || '-' WHEN 3 THEN '@' WHEN 4 THEN 'a=' ELSE '' END || text"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(x, '^[\\x00-\\x20\\x7F-\\x{{9F}}\\x{{1680}}\\x{{2000}}-\\x{{2006}}\\x{{2008}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{205F}}\\x{{3000}}]*[=+\\-@]') THEN '''' || x ELSE x END AS cell FROM (SELECT doc_id, {_GUARDED} AS x FROM documents)")
def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 6
    start = F.when(k == 0, "=").when(k == 1, "  +").when(k == 2, "\t-").when(k == 3, "@").when(k == 4, "a=").otherwise("")
    return table(spark, d, "documents").select("doc_id", S.csv_guard(F.concat(start, "text")).alias("cell"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+'), lambda w: lower(w)), '-') AS link, replace(p_name, ' ', '-') AS section
    FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN 'getHTTPResponse' WHEN 1 THEN 'completeUserTask' || p_partkey WHEN 2 THEN 'undefined' ELSE 'listJobsByKey' END AS x FROM part)""")
def kebab(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = F.when(k % 4 == 0, "getHTTPResponse").when(k % 4 == 1, F.concat(F.lit("completeUserTask"), k.cast("string"))).when(k % 4 == 3, "listJobsByKey")
    return table(spark, d, "part").select("p_partkey", S.kebab(x).alias("link"), S.section_link(F.col("p_name")).alias("section"))


@query("SELECT event_id, array_to_string(regexp_extract_all('flow node with id [' || event_type || '] and flow node with id [' || user_id || ']', 'flow node with id \\[[^\\]]*\\]'), ';') AS spans FROM events")
def regex_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("flow node with id ["), "event_type", F.lit("] and flow node with id ["), F.col("user_id").cast("string"), F.lit("]"))
    return table(spark, d, "events").select("event_id", F.array_join(S.spans(text, r"flow node with id \[[^\]]*\]"), ";").alias("spans"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Map<String, List<Part' || p_partkey || '>>' ELSE 'Part$Inner' END AS name FROM part")
def short_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = F.when(k % 2 == 0, F.concat(F.lit("java.util.Map<java.lang.String, java.util.List<org.a.Part"), k.cast("string"), F.lit(">>"))).otherwise("org.b_c.Part$Inner")
    return table(spark, d, "part").select("p_partkey", S.short_type(x).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 6 MONTH END AS cleanup FROM orders")
def auto_cancel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", S.cleanup_date(F.col("o_orderdate"), 6)).alias("cleanup"))


@query("""SELECT doc_id, (i - 1)::INTEGER AS line, repeat('#', least((doc_id % 6)::INTEGER + 2, 6)) || ' ' || t[i] AS heading, regexp_replace(regexp_replace(lower(regexp_replace(t[i], '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')), '[^a-z0-9_ \\t-\\r-]', '', 'g'), '[ \\t-\\r]+', '-', 'g') AS anchor
    FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))""")
def headings_toc(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    start = F.col("t")
    marked = F.concat(F.repeat(F.lit("#"), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" "), start)
    return lines.select("doc_id", "line", S.shift_heading(marked, 1).alias("heading"), S.anchor(start).alias("anchor"))


_EXPRESSIONS = ("${a == b && c}", "${execution.getVariable('x') == 1}", "${bean.call(y)}", "${execution.processInstanceId}", "x > 1", "${!done || late}")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '=a = b and c' WHEN 1 THEN '=x = 1' WHEN 2 THEN '${bean.call(y)}' WHEN 3 THEN '${execution.processInstanceId}' WHEN 4 THEN '=x > 1' ELSE '=not done or late' END AS expression,
    CASE WHEN event_id % 6 IN (2, 3) THEN 'TASK' ELSE 'REVIEW' END AS severity FROM events""")
def expr_rewrite(spark: SparkSession, d: str) -> DataFrame:
    x = F.element_at(F.array(*map(F.lit, _EXPRESSIONS)), (F.col("event_id") % 6).cast("int") + 1)
    return table(spark, d, "events").select("event_id", S.rewrite_expression(x).alias("expression"), S.expression_severity(x).alias("severity"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sendMail' WHEN 1 THEN event_type WHEN 2 THEN 'beanRun' ELSE NULL END AS worker FROM events")
def worker_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    x = F.when(k == 0, "org.x.SendMail").when(k == 1, F.concat(F.lit("${"), F.col("event_type"), F.lit("}"))).when(k == 2, "${bean.run(task)}")
    return table(spark, d, "events").select("event_id", S.worker_name(x).alias("worker"))


@query("SELECT n_nationkey, 'Check ' || n_name || ' in region ' || n_regionkey || ' of ' || n_name || '.' AS message FROM nation")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    text = S.fill(F.lit("Check {{ name }} in region {{region}} of {{ name}}."), {"name": F.col("n_name"), "region": F.col("n_regionkey")})
    return table(spark, d, "nation").select("n_nationkey", text.alias("message"))


@query("SELECT event_id, k, props->>('$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE k NOT LIKE 'z%'")
def prefix_delete(spark: SparkSession, d: str) -> DataFrame:
    flat = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(F.map_filter(flat, lambda k, v: ~k.startswith("z"))).alias("k", "value"))


# --- trees, plug-ins, streams ------------------------------------------------------------------------------------------------


@query("""SELECT 'r' || n_regionkey AS root, 'c' || c_custkey AS node, 'customer' AS kind, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def active_leaves(spark: SparkSession, d: str) -> DataFrame:
    def name(letter: str, key: str) -> Column:
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    nation, customer, region = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "region")
    edges = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).union(customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    kinds = nation.select(name("n", "n_nationkey").alias("node"), F.lit("sub-process").alias("kind")).union(customer.select(name("c", "c_custkey"), F.lit("customer")))
    return tree.active_leaves(edges, region.select(name("r", "r_regionkey").alias("root")), kinds, "sub-process").select("root", "node", "kind", "depth")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN upper(event_type) || '!' WHEN 'view' THEN event_type || '?!' ELSE event_type || '!' END AS value, event_type IN ('click', 'view') AS supported FROM events")
def udf_chain(spark: SparkSession, d: str) -> DataFrame:
    registry = Registry([Interceptor("mark", lambda v, k: F.concat(v, F.lit("!")), (), 300), Interceptor("upper", lambda v, k: F.upper(v), ("click",), 100), Interceptor("ask", lambda v, k: F.concat(v, F.lit("?")), ("view",), 200), Interceptor("off", lambda v, k: F.lit("no"))])
    registry.configure("off", enabled=False)
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("value"))
    types = F.array(F.lit("click"), F.lit("view"))
    return registry.transform(rows, "value", "event_type").select("event_id", "value", supports(types, F.col("event_type")).alias("supported"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0")
def job_drain(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files, drained once into a new folder."""
    import uuid

    from ferrylake.schemas import LEGACY_ID
    from ferrylake.sources.staging import shared_dir
    from ferrylake.streaming.drain import drain, not_externally_started

    schema = table(spark, d, "events").schema
    at = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"

    def jobs(rows: DataFrame) -> DataFrame:
        variables = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(f'{{"{LEGACY_ID}": "'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise("{}")
        return not_externally_started(rows.withColumn("variables", variables), "variables").select("event_id", "event_type")

    drain(spark, f"{d}/events.parquet*", schema, f"{at}/out", f"{at}/state", jobs)
    return spark.read.schema("event_id long, event_type string").parquet(f"{at}/out")


@query("SELECT n_nationkey::VARCHAR AS doc_id, i AS node, CASE i WHEN 0 THEN 'process' WHEN 1 THEN 'serviceTask' ELSE 'callActivity' END AS tag FROM nation CROSS JOIN (VALUES (0), (1), (2)) AS t(i)")
def xml_nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    xml = F.concat(F.lit('<p:process xmlns:p="urn:own" id="p'), k, F.lit('"><p:serviceTask id="s" class="org.a.Send"/><p:callActivity name="'), F.col("n_name"), F.lit('"/></p:process>'))
    return scans.xml_nodes(table(spark, d, "nation").select("n_nationkey", xml.alias("xml")), "n_nationkey", "xml").select("doc_id", "node", "tag")


@query("""SELECT n_nationkey::VARCHAR AS doc_id, s AS severity, CASE i WHEN 1 THEN 'Use send as the type of the worker for org.a.Send.' ELSE 'Check the variable mappings of ' || n_name || '.' END AS message
    FROM nation CROSS JOIN (VALUES (1, 'TASK'), (2, 'REVIEW')) AS t(i, s)""")
def xml_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    xml = F.concat(F.lit('<process id="p'), k, F.lit('"><serviceTask id="s" class="org.a.Send"/><callActivity name="'), F.col("n_name"), F.lit('"/></process>'))
    nodes = scans.xml_nodes(table(spark, d, "nation").select("n_nationkey", xml.alias("xml")), "n_nationkey", "xml")
    return findings.check_nodes(nodes).select("doc_id", "severity", "message")
