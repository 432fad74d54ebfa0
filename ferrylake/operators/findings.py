"""Findings of document checks: flattening, grouping, severities, version gates, rules over XML nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions.scalars import expression_severity, fill, rewrite_expression, worker_name
from ferrylake.operators.resolve import dealt_join, first_by
from ferrylake.schemas import SEVERITIES


def flatten(results: DataFrame) -> DataFrame:
    """Nested check results as one row a message; elements without messages vanish."""
    one = results.select("filename", F.posexplode("results").alias("ordinal", "r"))
    return one.select("filename", "ordinal", "r.element_id", "r.element_name", "r.element_type", F.posexplode("r.messages").alias("position", "m")).select("filename", "ordinal", "element_id", "element_name", "element_type", "position", "m.severity", F.col("m.id").alias("message_id"), "m.message", "m.link")


def severity_rank(x: Column) -> Column:
    """WARNING 0 to INFO 3; null for an unknown one."""
    return F.coalesce(*(F.when(x == s, i) for i, s in enumerate(SEVERITIES)))


def most_severe(rows: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """The gravest severity of each key; unknown ones don't count, and none is INFO."""
    rank = F.coalesce(F.min(severity_rank(F.col(severity))), F.lit(len(SEVERITIES) - 1))
    return rows.groupBy(key).agg(F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1).alias("severity"))


def severity_groups(rows: DataFrame, element: str) -> DataFrame:
    """Severities of each element with where they are first seen and how often. rows: position, severity."""
    return rows.groupBy(element, "severity").agg(F.min("position").alias("first_position"), F.count("*").alias("n"))


def severity_messages(rows: DataFrame, element: str) -> DataFrame:
    """Each message with its group, the messages of one severity on one element: first_position is where the group is first
    seen, so (element, first_position, position) is the order in which groups and their messages are listed. rows: position,
    severity, message. Long rows: no group is gathered, however large.
    """
    return dealt_join(rows, severity_groups(rows, element).drop("n"), [element, "severity"], "position").select(element, "severity", "first_position", "position", "message")


def first_match(elements: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of the first element of an id; elements that repeat it get none."""
    return first_by(elements, ["element"], ["ordinal"]).join(messages, "element", "left")


#: A rule table is broadcast; a larger one is an error.
MOST_RULES = 10_000


def gate(rules: DataFrame, version: DataFrame) -> DataFrame:
    """Rules that hold for a version: min_version <= version < before_version, either open. Compared as numbers."""
    v = F.col("version")
    holds = (F.col("min_version").isNull() | (v >= F.col("min_version"))) & (F.col("before_version").isNull() | (v < F.col("before_version")))
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    # Rules meet each version once, then versions meet the rows in an equi-join.
    held = version.select("version").distinct().join(F.broadcast(rules), holds)
    return version.join(held, "version").select(*version.columns, *rules.columns)


def missing(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """What should be covered and is not."""
    return expected.distinct().exceptAll(covered.distinct())


#: Rules of our own over XML nodes: element, attribute that must be there (or null), severity, id and text.
RULES = [
    ("callActivity", None, "REVIEW", "call-mapping", "Check the variable mappings of {{ name }}."),
    ("executionListener", None, "TASK", "listener", "Move the listener {{ value }} to a worker."),
    ("taskListener", None, "WARNING", "task-listener", "A task listener has no counterpart before version 8.8."),
    ("scriptTask", None, "REVIEW", "script", "The script of {{ name }} becomes a header of its task."),
    ("serviceTask", "class", "TASK", "delegate", "Use {{ worker }} as the type of the worker for {{ value }}."),
    ("serviceTask", "delegateExpression", "TASK", "delegate", "Use {{ worker }} as the type of the worker for {{ value }}."),
    ("businessRuleTask", "decisionRef", "INFO", "decision", "The decision {{ value }} is bound by its id."),
    ("multiInstanceLoopCharacteristics", "collection", "REVIEW", "collection", "The collection {{ value }} becomes {{ expression }}."),
    ("conditionExpression", None, "REVIEW", "condition", "The condition becomes {{ expression }}."),
    ("compensateEventDefinition", None, "WARNING", "unsupported", "{{ name }} has no counterpart."),
    ("cancelEventDefinition", None, "WARNING", "unsupported", "{{ name }} has no counterpart."),
]


def check_nodes(nodes: DataFrame) -> DataFrame:
    """Findings for the nodes of XML documents, by a broadcast join with the fixed rule table."""
    spark = nodes.sparkSession
    rules = spark.createDataFrame(RULES, "tag string, attribute string, severity string, message_id string, template string")
    value = F.when(F.col("attribute").isNull(), F.coalesce(F.col("attrs")["class"], F.col("attrs")["expression"], F.col("text"))).otherwise(F.element_at("attrs", F.col("attribute")))
    hit = nodes.where("error IS NULL").join(F.broadcast(rules), "tag").withColumn("value", value).where(F.col("attribute").isNull() | F.col("value").isNotNull())
    graver = F.when(F.col("message_id").isin("condition", "collection") & (expression_severity(F.col("value")) == "TASK"), "TASK").otherwise(F.col("severity"))
    named = F.coalesce("name", F.col("attrs")["id"], "tag")
    text = fill(F.col("template"), {"name": named, "value": F.col("value"), "worker": worker_name(F.col("value")), "expression": rewrite_expression(F.col("value"))})
    return hit.select("doc_id", "node", "tag", graver.alias("severity"), "message_id", text.alias("message"))
