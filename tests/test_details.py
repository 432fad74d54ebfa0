"""Descriptions of unknown shape, sections, settings, templates, children: what lacks something has a defined result."""

import pytest

from ferrylake.functions.scalars import nested
from ferrylake.operators import config, findings, resolve, specs, tree
from ferrylake.sources import scans
from ferrylake.streaming.drain import windowed


def test_descriptions(spark):
    rows = [
        (1, '{"paths": {"/a": {"get": {"summary": "s", "tags": ["t", null, 3, "u"], "deprecated": "yes"}, "servers": [1], "x-y": {}}}}'),
        (2, None), (3, ""), (4, "[]"), (5, '{"paths": []}'), (6, '{"paths": {}}'), (7, '{"paths": {"/a": null, "/b": {}, "/c": {"get": null, "put": {"tags": "t", "summary": {"x": 1}}}}}'), (8, '{"paths": {"/a": {}}} x'),
    ]
    got = sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in specs.operations(spark.createDataFrame(rows, "k int, text string"), "k", "text").collect()), key=str)
    assert got == [
        (1, "/a", "get", "s", ("t", "u"), False, None), (2, None, None, None, None, None, "no JSON"), (3, None, None, None, None, None, "no JSON"), (4, None, None, None, None, None, "no paths"), (5, None, None, None, None, None, "no paths"),
        (7, "/a", None, None, None, None, "path is no object"), (7, "/c", "get", None, None, None, "operation is no object"), (7, "/c", "put", '{"x":1}', (), False, None), (8, None, None, None, None, None, "no JSON"),
    ]


def test_large_descriptions(spark):
    text = '{"paths": {' + ", ".join(f'"/p{i}": {{"get": {{"tags": ["t{i % 3}"]}}, "put": {{}}}}' for i in range(20_000)) + "}}"
    found = specs.operations(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text")
    assert found.count() == 40_000 and found.where("error IS NOT NULL").count() == 0


def test_sections(spark):
    ops = spark.createDataFrame([("/a", "get", ["x", "y"], "mapped"), ("/a", "put", ["x"], "to be decided"), ("/b", "get", ["z"], "to be decided"), ("/b", "put", ["z", "q"], "mapped"), ("/c", "get", None, "mapped"), ("/a", "get", ["x", "y"], "mapped")], "path string, operation string, tags array<string>, status string")
    names = spark.createDataFrame([("x",), ("z",), ("z",), ("y",), ("w",)], "tag string")
    ask = lambda **how: sorted(tuple(r) for r in specs.shown_sections(ops, names, "status", **how).select("tag", "path", "operation").collect())
    assert ask() == [("x", "/a", "get"), ("x", "/a", "put"), ("y", "/a", "get"), ("z", "/b", "get"), ("z", "/b", "put")]
    assert ask(method="get") == [("x", "/a", "get"), ("y", "/a", "get"), ("z", "/b", "get")]
    assert ask(method="get", hide_open=True) == [("x", "/a", "get"), ("y", "/a", "get")]
    assert ask(hide_open=True) == ask() and ask(text="/A") == []


def test_settings(spark):
    with pytest.raises(ValueError, match="together with users"):
        config.Settings(skip_groups=True)
    with pytest.raises(ValueError, match="at least one row"):
        config.Settings(page_size=0)
    assert config.Settings(skip_groups=True, skip_users=True).page_size == 100
    assert config.job_tenants(["b", "a", "b"]) == ["<default>", "a", "b"] and config.job_tenants([]) == config.job_tenants(None) == []
    jobs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "c"), (5, "<default>")], "id int, tenant string")
    assert sorted(r.id for r in config.polled(jobs, "tenant", ["a"]).collect()) == [1, 2, 3, 5] and config.polled(jobs, "tenant", None).count() == 5


def test_nested_templates():
    blocks = {"a": "1 {{templates.b}} {{ name }}", "b": "2 {{ templates.c-d }}", "c-d": "3", "x": "{{ templates.y }}", "y": "{{ templates.x }}", "z": "{{ templates.none }}"}
    assert nested(blocks, "a") == "1 2 3 {{ name }}"
    with pytest.raises(ValueError, match="x > y > x"):
        nested(blocks, "x")
    with pytest.raises(KeyError, match="none"):
        nested(blocks, "z")


def test_child_decisions(spark):
    instances = spark.createDataFrame([("r", "r", 1), ("s", None, 1), ("c", "r", 2), ("d", "r", 2), ("d", "r", 2)], "id string, root_id string, evaluated int").distinct()
    values = spark.createDataFrame([("c", "n", "v"), ("c", "m", None), ("r", "n", "v")], "id string, name string, value string")
    got = sorted((tuple(r) for r in scans.child_decisions(instances, values, values.limit(0)).collect()), key=str)
    assert got == [("r", "c", 2, "input", "m", None), ("r", "c", 2, "input", "n", "v"), ("r", "d", 2, None, None, None)]


def test_messages_of_a_hot_element(spark):
    rows = spark.range(4000).selectExpr("IF(id % 4 > 0, 'hot', cast(id % 3 AS string)) AS element", "id AS position", "IF(id % 2 = 0, 'TASK', 'INFO') AS severity", "cast(id AS string) AS message")
    got = findings.severity_messages(rows, "element")
    assert got.count() == 4000 and {(r.severity, r.first_position) for r in got.where("element = 'hot'").distinct().collect()} == {("INFO", 1), ("TASK", 2)}


def test_maps_walks_and_windows(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("a", "y", None), ("b", "x", "2")], "scope string, name string, value string")
    assert {r.scope: r.variables for r in resolve.as_map(rows, "scope", "name", "value").collect()} == {"a": {"x": "1", "y": None}, "b": {"x": "2"}}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    assert sorted(r.node for r in tree.reachable(edges, spark.createDataFrame([("a",)], "root string")).collect()) == ["a", "b", "c"]
    times = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 20 * id) AS t, id % 2 AS k FROM range(6)")
    assert sorted((r.k, r.n) for r in windowed(times, "t", "k", "1 hour", "1 hour").collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
