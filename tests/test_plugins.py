"""Plug-in contracts: which types an interceptor takes, order, errors as rows, two phases, settings."""

import pytest
from pyspark.sql import functions as F

from ferrylake.functions import plugins as P
from ferrylake.functions.scalars import is_json
from ferrylake.schemas import HISTORY_TYPES

TREE = {"subclass": ("process instance",), "sub-subclass": ("subclass",)}


@pytest.mark.parametrize(
    ("types", "kind", "takes"),
    [
        ((), "process instance", True), ((), "flow node", True), (("process instance",), "process instance", True), (("process instance",), "flow node", False),
        (("process instance", "flow node", "user task"), "process instance", True), (("process instance", "flow node", "user task"), "user task", True), (("process instance", "flow node", "user task"), "variable", False),
        (("process instance",), "subclass", True), (("process instance",), "sub-subclass", True), (("subclass",), "process instance", False), (("variable",), None, False), ((), None, True),
    ],
)
def test_types(spark, types, kind, takes):
    row = spark.createDataFrame([(kind,)], "kind string").select(P.is_among(F.col("kind"), types, TREE).alias("x")).first()
    assert row.x is takes


def run(spark, rows, chain):
    df = spark.createDataFrame(rows, "name string, kind string, source string, entity string, error string")
    df = df.select(P.context(F.col("name"), F.col("kind"), F.col("source"), F.lit("history"), F.col("entity")).alias("context"), "error")
    return {r.context.name: r for r in P.run_variables(df, chain).collect()}


def test_errors_are_rows_and_end_the_chain(spark):
    def odd(row):
        if row["source"] is None or row["source"].startswith("x"):
            raise KeyError(row["name"])
        return len(row["source"])

    chain = [
        P.VariableInterceptor("last", lambda c: F.concat(c["value"], F.lit("L")), order=3),
        P.VariableInterceptor("b", lambda c: F.concat(F.coalesce(c["value"], F.lit("")), F.lit("b")), order=1),
        P.VariableInterceptor("a", lambda c: F.concat(F.coalesce(c["value"], F.lit("")), F.lit("a")), order=1),
        P.VariableInterceptor("number", lambda c: c["source"].cast("int"), ("number",), order=2, fails=lambda c: F.when(c["source"].try_cast("int").isNull(), "no int")),
        P.VariableInterceptor("python", types=("xml",), entities=("decision variable",), order=2, python=odd),
    ]
    got = run(spark, [("plain", "string", "q", "variable", "e"), ("int", "long", "12", "variable", "e"), ("bad", "long", "q", "variable", "e"), ("len", "xml", "four", "decision input", "e"), ("raise", "xml", "x", "decision output", "e"), ("none", "xml", None, "decision output", "e"), ("other", "xml", "x", "process variable", "e")], chain)
    assert {k: r.context.value for k, r in got.items()} == {"plain": "abL", "int": "12L", "bad": "ab", "len": "4L", "raise": "ab", "none": "ab", "other": "abL"}
    assert {k: tuple(r.context.error) for k, r in got.items() if r.context.error} == {"bad": ("number", "bad", "no int"), "raise": ("python", "raise", "KeyError: 'raise'"), "none": ("python", "none", "KeyError: 'none'")}
    assert all(r.error == "e" for r in got.values())


def test_null_contexts_and_no_rows(spark):
    df = spark.createDataFrame([(None,)], f"context {P.CONTEXT}")
    chain = [*P.VARIABLES, P.VariableInterceptor("any", lambda c: F.lit("x"))]
    assert P.run_variables(df, chain).first().context is None
    assert P.run_variables(df.limit(0), chain).count() == 0


def test_built_in_values(spark):
    rows = [(k, k, None, "variable", None) for k in ("json", "xml", "double", "date", "boolean", "bytes", "string", "null")] + [("huge", "string", "x" * 200_000, "variable", None), ("empty", "xml", "", "variable", None), ("unknown", "other", "x", "variable", None)]
    got = run(spark, rows, P.variables().ordered())
    assert got["huge"].context.value == "x" * 200_000 and got["unknown"].context.value is None
    assert got["empty"].context.error.interceptor == "xml"
    assert all(got[k].context.value is None and got[k].context.error is None for k in ("json", "xml", "double", "date", "boolean", "bytes", "string", "null"))


def test_settings():
    chain = P.variables()
    assert len(chain.ordered()) == 11 and [i.name for i in P.entities().ordered()] == sorted(HISTORY_TYPES)
    chain.configure("xml", enabled=False)
    assert "xml" not in [i.name for i in chain.ordered()] and "xml" in [i.name for i in P.variables().ordered()]
    with pytest.raises(KeyError):
        chain.configure("xml", enabled=False)
    with pytest.raises(ValueError, match="no properties"):
        chain.configure("json", properties={"indent": "2"})
    chain.add(P.VariableInterceptor("own", lambda c: c["source"], properties={"indent": "1"}))
    chain.configure("own", properties={"indent": "2"})
    assert next(i for i in chain.ordered() if i.name == "own").properties == {"indent": "2"}
    with pytest.raises(ValueError, match="either"):
        P.VariableInterceptor("none")


def test_parents_come_before_all_else(spark):
    df = P.begin(spark.createDataFrame([(1, "user task", {"instance_key": "7", "name": "n"}), (2, "user task", {"name": "m"}), (3, None, None)], "id int, kind string, entity map<string,string>"), P.TARGET)
    seen = P.EntityInterceptor("seen", lambda e, t: {"version": t["instance_key"]}, order=1)  # before the built-in in order, after it in phase
    strict = P.EntityInterceptor("strict", types=("user task",), order=50, parents_fail=lambda e, t: F.when(t["instance_key"].isNull(), "no parent"))
    chain = [seen, strict, *P.HISTORY]
    first = P.preset_parents(df, chain)
    assert {r.id: (r.target.instance_key, r.target.name) for r in first.collect()} == {1: ("7", None), 2: (None, None), 3: (None, None)}
    got = {r.id: (r.target.version, r.target.name, r.target.tenant, r.error and tuple(r.error)) for r in P.convert_entities(first, chain).collect()}
    assert got == {1: ("7", "n", "<default>", None), 2: (None, None, None, ("strict", "user task", "no parent")), 3: (None, None, None, None)}
    with pytest.raises(ValueError, match="which the target has not"):
        P.convert_entities(df, [P.EntityInterceptor("bad", lambda e, t: {"colour": F.lit(1)})])


def test_json_is_one_value(spark):
    cases = {'{"a": [1, {}]}': True, "1": True, ' "x" ': True, "null": True, "": False, "x": False, "1 2": False, "1, 2": False, '1, "b": 2': False, "1] x": False, "1} x": False, '{"k": 1}}': False, "[1": False, None: False}
    got = spark.createDataFrame([(k,) for k in cases], "k string").select("k", is_json(F.col("k")).alias("x")).collect()
    assert {r.k: r.x for r in got} == cases
