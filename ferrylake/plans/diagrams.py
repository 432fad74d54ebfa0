"""Queries over diagrams: findings of the whole catalogue, its coverage, conversion, priorities by scope."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.operators.convert import convert_nodes, nearest_scope
from ferrylake.plans import catalogue as C
from ferrylake.sources import scans
from ferrylake.sources.scans import table
from ferrylake.sources.staging import staged


def diagrams(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and xml: one process a supplier, whose fragment follows from its key."""
    suppliers = scans.spread(table(spark, d, "supplier").select("s_suppkey", "s_name"))
    return suppliers.select(F.col("s_suppkey").alias("doc_id"), C.document(F.col("s_suppkey"), F.col("s_name")).alias("xml"))


#: The versions of the golden rows.
VERSIONS = {x: C.v(x) for x in C.VERSIONS}


def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule holds in each document, at versions on both sides of all gates."""
    found = C.CATALOGUE.check_at(scans.xml_nodes(diagrams(spark, d), "doc_id", "xml"), VERSIONS)
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version", "rule").agg(F.count("*").alias("n"))


def _golden() -> str:
    rows = [(k, x, rule, n) for k in range(len(C.CASES)) for x in C.VERSIONS for rule, n in sorted(Counter(C.expected(k, x)).items())]
    return ", ".join(f"({k}, '{x}', '{rule}', {n})" for k, x, rule, n in rows)


RULE_FINDINGS = f"SELECT s_suppkey AS doc_id, version, rule, n::BIGINT AS n FROM supplier JOIN (VALUES {_golden()}) AS g(k, version, rule, n) ON s_suppkey % {len(C.CASES)} = k"


def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the catalogue with its findings over all documents, versions and options; none may be unused."""
    nodes = staged(scans.xml_nodes(diagrams(spark, d), "doc_id", "xml"), "nodes")
    found = C.CATALOGUE.check_at(nodes, VERSIONS).select("rule")
    for options, rules in C.BY_OPTION:
        found = found.unionByName(C.CATALOGUE.check_at(nodes, {C.VERSIONS[-1]: VERSIONS[C.VERSIONS[-1]]}, options, rules).select("rule"))
    rules = spark.createDataFrame([(r.id,) for r in C.CATALOGUE.rules], "rule string")
    return F.broadcast(rules).join(found.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("findings"))


def _coverage() -> str:
    rows: Counter = Counter()
    for k in range(len(C.CASES)):
        for x in C.VERSIONS:
            for rule, n in Counter(C.expected(k, x)).items():
                rows[k, rule] += n
    for _, rules in C.BY_OPTION:
        for rule, at in rules.items():
            for k, n in at.items():
                rows[k, rule] += n
    golden = ", ".join(f"({k}, '{rule}', {n})" for (k, rule), n in sorted(rows.items()))
    return f"SELECT rule, sum(n)::BIGINT AS findings FROM supplier JOIN (VALUES {golden}) AS g(k, rule, n) ON s_suppkey % {len(C.CASES)} = k GROUP BY rule"


def xml_convert(spark: SparkSession, d: str) -> DataFrame:
    """Documents converted for the last version. Fragments 0, 2 and 4 only: those that golden documents are written for."""
    docs = scans.spread(table(spark, d, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("doc_id"), C.document(F.pmod("p_partkey", F.lit(3)) * 2, F.col("p_name")).alias("xml"))
    nodes = scans.xml_nodes(docs, "doc_id", "xml", source=True)
    return convert_nodes(nodes, C.CATALOGUE.edits(C.v("8.10"))).select(F.col("doc_id").cast("long").alias("doc_id"), "xml", "applied")


#: Converted fragments, written by hand.
GOLDEN = (
    (0, 18, """<process id="p" versionTag="2" name="NAME">
  <callActivity id="c" bindingType="deployment" versionTag="1" allFromParent="true" allFromChild="true">
    <extensionElements>
      <in sourceExpression="${x.y()}" target="d" />
    </extensionElements>
    <input source="=a" target="b" />
    <output source="=b" target="a" />
    <input source="=z" target="z" />
  </callActivity>
  <versionTag value="2" />
</process>"""),
    (1, 21, """<process id="p" versionTag="2" name="NAME">
  <serviceTask id="s" retries="3">
    <extensionElements>
      <inputOutput>
        <inputParameter name="p">${a}</inputParameter>
        <inputParameter name="q">
          <list />
        </inputParameter>
        <inputParameter name="r">
          <script scriptFormat="groovy">y</script>
        </inputParameter>
      </inputOutput>
    </extensionElements>
    <header key="class" value="org.a.Send" />
    <jobType type="send" />
    <header key="resultVariable" value="r" />
    <listener event="start" type="org.a.L" />
    <listener event="end" type="" />
    <priority value="90" />
  </serviceTask>
  <versionTag value="2" />
</process>"""),
    (2, 19, """<process id="p" versionTag="2" name="NAME">
  <scriptTask id="g" scriptFormat="groovy">
    <header key="language" value="groovy" />
    <jobType type="script" />
    <header key="resultVariable" value="v" />
    <header key="script" value="1 + 1" />
    <priority value="=p" />
  </scriptTask>
  <scriptTask id="o" scriptFormat="feel" resultVariable="w">
    <script>=a + b</script>
  </scriptTask>
  <scriptTask id="e" scriptFormat="groovy">
    <header key="language" value="groovy" />
    <jobType type="script" />
    <header key="resource" value="s.groovy" />
  </scriptTask>
  <versionTag value="2" />
</process>"""),
)


def _converted() -> str:
    rows = ", ".join(f"({k}, {n}, '{xml}')" for k, n, xml in GOLDEN)
    return f"SELECT p_partkey AS doc_id, replace(x, 'NAME', p_name) AS xml, applied::INT AS applied FROM part JOIN (VALUES {rows}) AS g(k, applied, x) ON p_partkey % 3 = k"


def priority_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The priority that counts for each task of a worker: its own, or that of the nearest scope around it."""
    o = scans.spread(table(spark, d, "orders").select("o_orderkey"), 50_000)
    k = F.col("o_orderkey")
    own = F.when(k % 3 == 0, F.concat(F.lit('jobPriority="'), (k % 7).cast("string"), F.lit('"'))).otherwise("")
    inner = F.when(k % 2 == 0, F.lit('jobPriority="77"')).otherwise("")
    whole = F.when(k % 5 != 0, F.concat(F.lit('jobPriority="'), (k % 11).cast("string"), F.lit('"'))).otherwise("")
    xml = F.concat(F.lit('<process id="p" '), whole, F.lit('><sendTask id="a"/><subProcess id="s" '), inner, F.lit('><serviceTask id="b" '), own, F.lit('/><subProcess id="t"><sendTask id="c"/></subProcess></subProcess><sendTask id="e"/></process>'))
    nodes = scans.xml_nodes(o.select(k.alias("doc_id"), xml.alias("xml")), "doc_id", "xml").select("doc_id", "node", "last", "tag", F.col("attrs")["id"].alias("id"), F.col("attrs")["jobPriority"].alias("priority"))
    nodes = staged(nodes, "nodes")
    found = nearest_scope(nodes.where(F.col("tag").isin(*C.WORKERS)), nodes.where("priority IS NOT NULL"))
    # Both sides grow with the documents, and their files are far smaller than their rows: neither may be broadcast for its files' size.
    ids = found.join(nodes.where(F.col("tag").isin(*C.WORKERS)).select("doc_id", "node", "id").hint("merge"), ["doc_id", "node"])
    value = nodes.where("priority IS NOT NULL").select("doc_id", F.col("node").alias("scope"), "priority").hint("merge")
    return ids.join(value, ["doc_id", "scope"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "id", F.col("priority").cast("int").alias("priority"))


PRIORITY_SCOPES = """
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 11 END AS w, CASE WHEN o_orderkey % 2 = 0 THEN 77 END AS i, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS own FROM orders)
SELECT k AS doc_id, id, CASE id WHEN 'a' THEN w WHEN 'e' THEN w WHEN 'b' THEN coalesce(own, i, w) ELSE coalesce(i, w) END::INT AS priority FROM o, (VALUES ('a'), ('b'), ('c'), ('e')) AS t(id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (rule_findings, rule_coverage, xml_convert, priority_scopes)}


def oracle_sql() -> dict[str, str]:
    return {"rule_findings": RULE_FINDINGS, "rule_coverage": _coverage(), "xml_convert": _converted(), "priority_scopes": PRIORITY_SCOPES}
