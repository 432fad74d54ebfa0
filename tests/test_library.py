"""Golden rows for scalars, and end-to-end invariants of the ledger, sources and sinks."""

import datetime

import pytest
from pyspark.sql import functions as F

from ferrylake.functions import interceptors
from ferrylake.functions import scalars as S
from ferrylake.operators import findings, ledger, resolve, tree
from ferrylake.schemas import LEDGER
from ferrylake.sources import scans, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "guarded"),
    [("=1", "'=1"), ("  +x", "'  +x"), ("\t-1", "'\t-1"), ("@a", "'@a"), ("plain", "plain"), ("a=b", "a=b"), ("", ""), (None, None), ("\u0000=1", "'\u0000=1")],
)
def test_csv_guard(spark, text, guarded):
    assert one(spark, S.csv_guard(F.lit(text).cast("string"))) == guarded


@pytest.mark.parametrize(("text", "problem"), [(None, None), ("", "blank"), ("  ", "blank"), ("a" * 100, None), ("a" * 101, "too long"), ("1a", "bad characters"), ("_a.b-c", None), ("a b", "bad characters")])
def test_prefix(spark, text, problem):
    assert one(spark, S.prefix_problem(F.lit(text).cast("string"))) == problem


@pytest.mark.parametrize(("counter", "key"), [(0, 9221120237041090560), (2**51 - 1, 2**63 - 1)])
def test_key_bounds(spark, counter, key):
    assert one(spark, S.key_encode(F.lit(counter))) == key
    assert one(spark, S.key_partition(S.key_encode(F.lit(counter)))) == 4095


@pytest.mark.parametrize(("text", "name"), [("org.x.SendMail", "sendMail"), ("${mail}", "mail"), ("${mail.send(task)}", "mailSend"), ("Plain", "plain"), (None, None)])
def test_worker_name(spark, text, name):
    assert one(spark, S.worker_name(F.lit(text).cast("string"))) == name


@pytest.mark.parametrize(("text", "name"), [(None, "undefined"), ("getHTTPResponse", "get-http-response"), ("listJobs2", "list-jobs")])
def test_kebab(spark, text, name):
    assert one(spark, S.kebab(F.lit(text).cast("string"))) == name


def test_other_scalars(spark):
    assert one(spark, S.tenant_default(F.lit(""))) == "<default>"
    assert one(spark, S.text_of(F.lit(None))) == "null"
    assert one(spark, S.legacy_prefix(F.lit(None).cast("string"))) is None
    assert one(spark, S.short_type(F.lit("a.B<c.D, e.f.G<h.I>>"))) == "B<D, G<I>>"
    assert one(spark, S.cleanup_date(F.lit("2024-08-31").cast("timestamp_ntz"))) == datetime.datetime(2025, 2, 28)
    assert one(spark, S.version_number(F.lit("8.10")) > S.version_number(F.lit("8.9")))
    assert one(spark, S.fill(F.lit("{{a}} {{ b }}"), {"a": F.lit("{{ b }}$1"), "b": F.lit("x")})) == "x$1 x"
    assert one(spark, S.shift_heading(F.lit("##### x"), 4)) == "###### x"
    assert one(spark, S.file_kind(F.lit("A.BPMN20.xml"))) == "process"
    assert one(spark, S.file_kind(F.lit("a.txt"))) is None
    assert one(spark, S.component_id(F.lit("cockpit"))) == "operate"
    assert one(spark, S.effective_job_type(F.lit("a"), F.lit("DISABLED"))) is None
    assert one(spark, S.effective_job_type(F.lit("a"), F.lit(None).cast("string"))) == "a"
    assert not one(spark, S.is_false(F.lit(None).cast("string")))


def test_supports(spark):
    kind, none = F.lit("a"), F.array().cast("array<string>")
    assert one(spark, interceptors.supports(none, kind))
    assert one(spark, interceptors.supports(F.array(F.lit("a")), kind))
    assert not one(spark, interceptors.supports(F.array(F.lit("b")), kind))
    r = interceptors.Registry(list(interceptors.BUILTIN))
    with pytest.raises(ValueError):
        r.configure("null", properties={"x": "y"})
    with pytest.raises(KeyError):
        r.configure("nothing")
    rows = spark.createDataFrame([("TRUE", "boolean"), (" 1 ", "long"), ("x", "null"), ("{bad", "json"), ("2024-01-02", "date"), ("s", "string")], "v string, k string")
    assert [x.v for x in r.transform(rows, "v", "k").collect()] == ["true", "1", None, None, "2024-01-02T00:00:00", "s"]


def rows(spark, *values):
    return spark.createDataFrame([(*v[:3], None, *v[3:]) for v in values], LEDGER)


def test_upsert_states(spark):
    old = rows(spark, ("a", None, "t", "why", 1), ("b", "1", "t", None, 2), ("c", None, "t", "why", 3))
    delta = rows(spark, ("a", "9", "t", None, None), ("b", "5", "t", None, 7), ("c", None, "t", "new", 8), ("d", None, "t", "x", 4), ("a", "2", "u", None, 5))
    for save in (True, False):
        got = {(r.src_id, r.type): (r.tgt_key, r.skip_reason, r.partition_id) for r in ledger.upsert(old, delta, save).collect()}
        assert got == {("a", "t"): ("9", None, 1), ("b", "t"): ("1", None, 2), ("c", "t"): (None, "new" if save else "why", 3), ("d", "t"): (None, "x" if save else None, 4), ("a", "u"): ("2", None, 5)}
    again = ledger.upsert(ledger.upsert(old, delta, True), delta, True)
    assert sorted(again.collect()) == sorted(ledger.upsert(old, delta, True).collect())


def test_every_source_row_is_moved_skipped_or_pending(spark, small):
    from ferrylake.plans.registry import L, orders_by_id

    o = orders_by_id(spark, small)
    led = L(spark, small)
    assert led.where(ledger.is_skipped()).count() + led.where(ledger.has_moved()).count() + ledger.pending(o, led, "src_id", "order").count() == o.count()
    assert not sinks.drop_allowed(led)
    assert sinks.drop_allowed(led, force=True)


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "ledger")
    sinks.publish(rows(spark, ("a", None, "t", None, 1)), at)
    sinks.publish(rows(spark, ("a", "1", "t", None, 1), ("b", None, "t", None, 1)), at)
    assert sinks.published(spark, at).count() == 2
    assert sinks.empty_ledger(spark).schema == LEDGER


def test_find_one(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert sorted((r.k, r.v, r.outcome) for r in resolve.find_one(left, right, ["k"], "v").collect()) == [(1, "a", "found"), (2, None, "ambiguous"), (3, None, "missing")]


def test_tree_with_orphans_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "b")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("lone",)], "root string")
    assert sorted((r.root, r.node, r.depth) for r in tree.descendants(edges, roots).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("lone", "lone", 0)]


def test_fixpoint_stops_and_refuses_to_fall_back(spark):
    state = spark.createDataFrame([(1, None), (2, "x")], "id int, tgt_key string")
    assert resolve.retry_to_fixpoint(state, lambda s: s).count() == 2
    with pytest.raises(RuntimeError):
        resolve.retry_to_fixpoint(state, lambda s: s.withColumn("tgt_key", F.lit(None).cast("string")))


def test_files_and_xml(spark, tmp_path):
    for name in ("a.bpmn", "deep/b.dmn", ".hidden", "deep/.git/c.bpmn"):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("<process id='p'/>")
    names = [r.path.rsplit("/", 1)[-1] for r in scans.resource_files(spark, str(tmp_path / "in")).select("path").collect()]
    assert sorted(names) == ["a.bpmn", "b.dmn"]
    assert scans.resource_files(spark, "  ").count() == scans.resource_files(spark, None).count() == 0
    docs = spark.createDataFrame([("ok", "<a><b x='1'><c/></b><d>t</d></a>"), ("bad", "<a>"), ("none", None)], "id string, xml string")
    got = {(r.doc_id, r.node): (r.tag, r.parent, r.depth, r.error is None) for r in scans.xml_nodes(docs, "id", "xml").collect()}
    assert got[("ok", 0)] == ("a", -1, 0, True) and got[("ok", 2)] == ("c", 1, 2, True) and got[("ok", 3)] == ("d", 0, 1, True)
    assert not got[("bad", None)][3] and not got[("none", None)][3]
    assert sinks.pretty_xml(docs).where("id = 'ok'").first().pretty.startswith("<a>\n  <b")


def test_reports(spark, tmp_path):
    names = "filename element_name element_id element_type severity message_id message link".split()
    df = spark.createDataFrame([("f", "n", "e", "t", "TASK", "m", "=1;x", None), ("f", "n", "e", "t", "INFO", "m", "b", "l")], ", ".join(f"{n} string" for n in names))
    sinks.csv_report(df, str(tmp_path / "csv"))
    back = spark.read.option("sep", ";").option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns == names and {r.message for r in back.collect()} == {"'=1;x", "b"}
    text = sinks.markdown_report(df.withColumn("position", F.when(F.col("message") == "b", 0).otherwise(1))).first().report
    assert text.index("INFO (1)") < text.index("TASK (1)")
    archives = sinks.zip_batch(spark.createDataFrame([("a", b"1"), ("b", b"2")], "filename string, content binary"))
    assert archives.agg(F.sum("files")).first()[0] == 2


def test_versions_and_severities(spark):
    rows_ = spark.createDataFrame([("f", "OTHER"), ("g", "INFO"), ("g", "TASK"), ("h", None)], "k string, severity string")
    assert sorted((r.k, r.severity) for r in findings.most_severe(rows_, "k").collect()) == [("f", "INFO"), ("g", "TASK"), ("h", "INFO")]


def test_drain_takes_only_new_files(spark, tmp_path):
    from ferrylake.streaming.drain import drain

    at = str(tmp_path / "in")
    spark.range(3).write.parquet(at)
    args = (spark, at, spark.range(1).schema, str(tmp_path / "out"), str(tmp_path / "state"), lambda d: d)
    drain(*args)
    drain(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    spark.range(2).write.mode("append").parquet(at)
    drain(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
