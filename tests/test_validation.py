"""Instance trees: every reason, their order, and rows that lack something."""

import pytest
from pyspark.sql import functions as F

from ferrylake.operators import resolve
from ferrylake.operators.resolve import dealt_join, hot_keys
from ferrylake.operators.validation import validate
from ferrylake.plans import trees
from ferrylake.sources.scans import xml_nodes

OK = '<process><startEvent id="s"><extensionElements><executionListeners><executionListener type="m"/></executionListeners></extensionElements></startEvent><task id="a"/><callActivity id="c">{}</callActivity></process>'
CLOSED = '<extensionElements><calledElement propagateAllParentVariables="False"/>{}</extensionElements>'


def ask(spark, instances, active, target, source="<process><task id='a'/><task id='b'/><callActivity id='c'/><parallelGateway id='g'/></process>", deployed=None, tenants=("x",), job="m"):
    docs = lambda t: xml_nodes(spark.createDataFrame([("d", t)], "doc_id string, xml string"), "doc_id", "xml")
    rows = spark.createDataFrame(instances, "root int, instance int, source string, target string, tenant string")
    nodes = spark.createDataFrame(active, "instance int, node string")
    there = spark.createDataFrame(deployed or [("d", None, 1, "d")], "target string, tenant string, version int, doc_id string")
    return {r.root: (r.reason, r.aborts) for r in validate(rows, nodes, docs(source), docs(target), there, tenants, job).collect()}


def one(spark, node, target, **how):
    return ask(spark, [(1, 1, "d", "d", None)], [(1, node)], target, **how)[1]


def test_first_failing_instance_and_node(spark):
    instances = [(1, 1, "d", "d", ""), (1, 2, "d", "d", None), (1, 3, "d", "d", "y"), (2, 4, "d", "d", None), (3, 5, "d", "d", "x"), (4, 6, "d", None, None), (5, 7, "d", "d", None), (5, 7, "d", "d", None)]
    active = [(1, "a"), (2, "g"), (2, "b"), (2, "a"), (4, None), (7, "g"), (7, "g"), (99, "b")]
    got = ask(spark, instances, active, OK.format(""))
    assert got == {
        1: ("b is missing in the target's model", False),
        2: (None, False),
        3: ("d is not deployed for tenant x", False),
        4: (" is not deployed", False),
        5: ("g waits to join branches", False),
    }


def test_calls(spark):
    assert one(spark, "c", OK.format("")) == (None, False)
    assert one(spark, "c", OK.format(CLOSED.format("")))[0] == "c neither passes all variables on nor maps legacyId"
    assert one(spark, "c", OK.format(CLOSED.format('<ioMapping><input target="legacyId"/></ioMapping>'))) == (None, False)
    assert one(spark, "c", OK.format(CLOSED.format('<ioMapping><input target="other"/></ioMapping>')))[0] is not None


def test_models(spark):
    assert one(spark, "a", "<process><startEvent id='s'/>") == ("the model of d cannot be read", True)
    assert one(spark, "zz", OK.format("")) == ("zz is not in its own model", True)
    bare = "<process><startEvent id='s'/><task id='a'/></process>"
    assert one(spark, "a", bare)[0] == "start event s has no listener for jobs of type m"
    assert one(spark, "a", bare, job=None) == (None, False)
    assert one(spark, "a", "<process><task id='a'/></process>")[0] == "d has no start event without a trigger"
    inner = "<process><subProcess id='u'><startEvent id='s'/></subProcess><task id='a'/></process>"
    assert one(spark, "a", inner, job=None)[0] == "d has no start event without a trigger"
    newer = [("d", None, 1, "gone"), ("d", None, 2, "d")]
    assert one(spark, "a", OK.format(""), deployed=newer) == (None, False)
    assert one(spark, "a", OK.format(""), deployed=newer[::-1] + [("d", "", 3, "gone")]) == ("the model of d cannot be read", True)


def test_no_rows(spark):
    assert ask(spark, [], [], OK.format("")) == {}


def test_every_reason_occurs(spark, small):
    found = {r.reason for r in trees.instance_validation(spark, small).collect()}
    for part in (None, "tenant red", "deployed for", "is not deployed", "cannot be read", "without a trigger", "no listener", "work runs", "own model", "each runs", "waits to join", "is missing", "neither passes"):
        assert any((r is None) if part is None else (r is not None and part in r) for r in found), part


def test_dealt_join_with_a_hot_key(spark):
    left = spark.range(3000).selectExpr("id", "IF(id % 3 > 0, 'hot', cast(id % 7 AS string)) AS k")
    right = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3)], "k string, v int")
    got = dealt_join(left, right, ["k"], "id").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {1: 2000, 2: 143, 3: 143, None: 714}
    with pytest.raises(ValueError, match="only inner and left"):
        dealt_join(left, right, ["k"], "id", "full")


def test_dealt_join_copies_rows_of_hot_keys_only(spark, monkeypatch):
    monkeypatch.setattr(resolve, "HOT_ROWS", 500)
    left = spark.range(3000).selectExpr("id", "IF(id % 3 > 0, 'hot', cast(id % 7 AS string)) AS k")
    right = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3)], "k string, v int")
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n")
    assert len(hot) == 1 and hot_keys(left.limit(0).groupBy("k").agg(F.count("*").alias("n")), ["k"], "n") == []
    for some in (hot, []):
        got = dealt_join(left, right, ["k"], "id", hot=some).groupBy("v").count().collect()
        assert {r.v: r["count"] for r in got} == {1: 2000, 2: 143, 3: 143, None: 714}


def test_nodes_that_come_with_their_instances(spark):
    docs = lambda t: xml_nodes(spark.createDataFrame([("d", t)], "doc_id string, xml string"), "doc_id", "xml")
    twice = "<process><task id='a'/><callActivity id='c'/><parallelGateway id='a'/><task/></process>"
    rows = [(1, 1, "d", "d", None, ["c", None, "a"]), (2, 2, "d", "d", "", None), (3, 3, "d", "d", "no", ["a"]), (4, 4, "d", "e", "x", ["a"]), (5, 5, "d", "d", "x", ["b"]), (6, 6, "d", "d", None, ["a", "q"]), (6, 5, "d", ">", None, [None])]
    instances = spark.createDataFrame(rows, "root int, instance int, source string, target string, tenant string, nodes array<string>")
    deployed = spark.createDataFrame([("d", None, 1, "d"), ("d", "x", 1, "d")], "target string, tenant string, version int, doc_id string")
    got = {r.root: (r.reason, r.aborts) for r in validate(instances, None, docs(twice), docs(OK.format("")), deployed, ["x"], "m").collect()}
    assert got == {
        1: (None, False),
        2: (None, False),
        3: ("tenant no is not among those of this run", False),
        4: ("e is not deployed for tenant x", False),
        5: ("b is not in its own model", True),
        6: ("> is not deployed", False),
    }
