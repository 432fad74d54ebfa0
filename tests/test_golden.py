"""Fixed cases: what each function must give, independent of the queries' SQL."""

import pytest
from pyspark.sql import functions as F

from ferrylake.functions import scalars as S
from ferrylake.functions.interceptors import Interceptor, Registry
from ferrylake.operators import findings, pipeline, resolve, tree
from ferrylake.plans import history
from ferrylake.schemas import HISTORY_TYPES, LEDGER
from ferrylake.sources import sinks


def results(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (S.csv_guard, {"=1": "'=1", "+1": "'+1", "-1": "'-1", "@x": "'@x", " =1": "' =1", "\t\r\n=1": "'\t\r\n=1", "\x85=1": "'\x85=1", "\u2003=1": "'\u2003=1", "\x00=1": "'\x00=1", "a=1": "a=1", "": "", None: None, "\u00a0a": "\u00a0a", " ": " "}),
        (S.kebab, {"getHTTPResponse": "get-http-response", "getX509Cert": "get-x-cert", "completeUserTask2": "complete-user-task", "listJobsByKey": "list-jobs-by-key", "ID": "id", None: "undefined", "42": "", "aBC": "a-bc", "ABc": "a-bc"}),
        (S.prefix_problem, {None: None, "": "blank", "  ": "blank", "\t": "blank", "\u2003\n": "blank", "a" * 100: None, "a" * 101: "too long", "_a.b-c": None, "1a": "bad characters", "a b": "bad characters", "é": "bad characters"}),
        (S.anchor, {"a_b\tc": "a_b-c", " Two  Words ": "two-words", "What's new?": "whats-new", "a - b": "a---b"}),
        (S.toc_line, {"# One": None, "## Two": "- [Two](#two)", "### A b ": "  - [A b](#a-b)", "#### C": "    - [C](#c)", "##### D": None, "text": None}),
        (S.strip_number, {"10-client_code": "client code", "20_a-b.md": "a b", "x.md": "x"}),
        (S.intro, {"# T\n\n one \ntwo": "one", "# T": "", "": ""}),
    ],
)
def test_scalars(spark, f, cases):
    assert results(spark, f, list(cases)) == list(cases.values())


def test_title(spark):
    title = lambda x: S.title(x, F.lit("some-file_name.md"))
    assert results(spark, title, ["a\n# The title \nb", "## no", ""]) == ["The title", "some file name", "some file name"]


def test_bounds_are_errors_not_cuts(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "parent int, child int")
    roots = spark.createDataFrame([(0,)], "root int")
    assert tree.descendants(edges, roots).count() == 7
    with pytest.raises(RuntimeError, match="deeper"):
        tree.descendants(edges, roots, most=3)
    state = spark.createDataFrame([(i, None) for i in range(5)], "id int, tgt_key string")
    step = lambda s: s.withColumn("tgt_key", F.when(F.col("id") <= s.where("tgt_key IS NOT NULL").count(), "k"))
    assert resolve.retry_to_fixpoint(state, step).where("tgt_key IS NULL").count() == 0
    with pytest.raises(RuntimeError, match="rounds"):
        resolve.retry_to_fixpoint(state, step, most=2)
    monkeypatch.setattr(findings, "MOST_RULES", 2)
    rules = spark.createDataFrame([(str(i), None, None) for i in range(3)], "rule string, min_version int, before_version int")
    with pytest.raises(ValueError, match="rules"):
        findings.gate(rules, spark.createDataFrame([(8003,)], "version int"))


def test_registries_do_not_share_settings():
    one = Interceptor("a", lambda v, k: v, properties={"p": "1"})
    first, second = Registry([one]), Registry([one])
    first.configure("a", properties={"p": "2"})
    assert [r.ordered()[0].properties["p"] for r in (first, second)] == ["2", "1"]
    with pytest.raises(ValueError):
        first.configure("a", properties={"q": "1"})


def test_batches_hold_at_most_their_size(spark):
    files = spark.createDataFrame([(f"f{i}", b"x") for i in range(25)], "filename string, content binary").repartition(4)
    assert sorted(r.files for r in sinks.zip_batch(files, 10).select("files").collect()) == [5, 10, 10]


def test_numbers_are_gapless(spark):
    rows = resolve.numbered(spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000).repartition(7), "k").collect()
    assert all(r.position == r.k + 1 for r in rows)


def test_every_source_row_ends_moved_or_skipped_once(spark, small):
    made, ledger = history.sources(spark, small), history.first_ledger(spark, small)
    tables = {}
    how = {"counter": lambda x: x.cast("long"), "drawn": F.pmod(F.col("id"), F.lit(3)) + 1}
    kinds = ("form definition", "process definition", "process instance", "flow node")
    after = pipeline.run({k: made[k]() for k in kinds}, ledger, [history.SPECS[k] for k in kinds], lambda s, rows: tables.update({s.kind: rows.count()}), **how)
    assert after.columns == [f.name for f in LEDGER] and list(tables) == list(kinds)
    for k in kinds:
        mine = after.where(F.col("type") == k)
        ids = made[k]().select(F.col("id").cast("string")).distinct()
        assert mine.count() == mine.select("src_id").distinct().count() == ids.count()
        assert mine.where("tgt_key IS NULL AND skip_reason IS NULL OR tgt_key IS NOT NULL AND skip_reason IS NOT NULL").isEmpty()
    again = pipeline.run({k: made[k]() for k in kinds}, after, [history.SPECS[k] for k in kinds], **how)
    assert again.exceptAll(after).isEmpty() and after.exceptAll(again).isEmpty()
    fixed = pipeline.run_to_fixpoint({"process instance": made["process instance"]()}, after.where("type <> 'process instance' OR tgt_key IS NOT NULL"), [history.SPECS["process instance"]], **how)
    assert fixed.where("tgt_key IS NULL").count() <= after.where("tgt_key IS NULL").count()
    assert set(history.SPECS) == set(HISTORY_TYPES)
