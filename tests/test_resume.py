"""Resumed scans, pages, listings, local times and file kinds by fixed cases."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ferrylake.functions import scalars as S
from ferrylake.operators import ledger as L
from ferrylake.operators import pipeline
from ferrylake.operators.pipeline import Parent, Pipeline, Rule
from ferrylake.operators.resume import Scan, resumed
from ferrylake.plans import resumed as plans
from ferrylake.schemas import LEDGER
from ferrylake.sources import scans

DAY = lambda n: datetime.datetime(2024, 1, n)
SCAN = Scan("job", "id", "at", ("log",), "kind <> 'no'")
ROWS = [(1, DAY(1), 9, "a"), (2, DAY(3), 5, "a"), (3, DAY(3), 4, "a"), (4, DAY(2), 1, "a"), (5, None, 1, "a"), (6, DAY(4), 1, "no"), (7, DAY(3), 4, "a"), (8, DAY(4), 1, None)]


def of_ledger(spark, *rows):
    return spark.createDataFrame([(str(i), key, kind, time, None, None) for i, key, kind, time in rows], LEDGER)


def test_scans_go_on_after_the_latest_known_row_of_their_type(spark):
    source = spark.createDataFrame(ROWS, "id int, at timestamp_ntz, log int, kind string")
    ids = lambda *rows: [r.id for r in resumed(source, SCAN, of_ledger(spark, *rows)).collect()]
    assert ids() == [5, 1, 4, 3, 7, 2]  # nulls first, then time, log, id
    assert ids((1, "k", "incident", DAY(9)), (2, "k", "job", None)) == [5, 1, 4, 3, 7, 2]
    assert ids((1, "k", "job", DAY(1)), (4, None, "job", DAY(2))) == [5, 3, 7, 2]  # skipped rows count, too
    assert ids((1, "k", "job", DAY(3))) == [5]
    assert resumed(source.limit(0), SCAN, of_ledger(spark)).count() == 0


def test_the_latest_time_is_read_with_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, at timestamp_ntz, log int, kind string").write.parquet(f"{tmp_path}/rows")
    due = resumed(spark.read.parquet(f"{tmp_path}/rows"), SCAN, of_ledger(spark, (1, "k", "job", DAY(2))))
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [r.id for r in due.collect()] == [5, 3, 7, 2]


def test_a_resumed_run_ends_as_one_run_over_all_rows(spark):
    instances = Pipeline("process instance", "id", "at", (Rule("kind = 'no'", "is not wanted"),), only="kind IS NOT NULL")
    tasks = Pipeline("user task", "id", "at", (Parent("instance", "instance", "process instance", "instance missing"),), partition_of="instance")
    rows = spark.createDataFrame([(i, DAY(1 + i // 3), "no" if i % 4 == 0 else None if i % 5 == 0 else "a", i + 1) for i in range(60)], "id int, at timestamp_ntz, kind string, instance int")
    empty = spark.createDataFrame([], LEDGER)
    how = {"counter": lambda x: x.cast("long"), "drawn": F.pmod(F.col("id"), F.lit(3)) + 1}
    both = lambda some: {"process instance": some, "user task": some}
    whole = pipeline.run(both(rows), empty, [instances, tasks], **how)
    first = pipeline.run({"process instance": rows, "user task": rows.where("id < 30")}, empty, [instances, tasks], **how)
    counts = {}
    after = pipeline.run(both(rows), first, [instances, tasks], resume=True, counts=counts, **how)
    assert after.exceptAll(whole).isEmpty() and whole.exceptAll(after).isEmpty()
    assert counts["process instance"] == (0, 0) and sum(counts["user task"]) == 30
    assert whole.where("type = 'process instance'").count() == sum(i % 5 > 0 or i % 4 == 0 for i in range(60))
    late = pipeline.run({"user task": rows.where("id < 3")}, after.where("src_id > '3'"), [tasks], resume=True, **how)
    assert late.where("type = 'user task' AND src_id IN ('0', '1', '2')").isEmpty()  # before the latest: not read


@pytest.mark.parametrize("i", range(len(plans.SCANS)))
def test_each_scan_is_in_its_order(spark, small, i):
    scan = plans.SCANS[i][0]
    if scan.kind == "decision instance":  # its order ends where the values join
        return
    rows = [(r.time, *(getattr(r, t) for t in scan.ties), r.id) for r in plans.scanned(spark, small, i, ordered=True).collect()]
    assert rows and rows == sorted(rows)


def test_values_are_nested_in_their_order(spark):
    ids = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    values = spark.createDataFrame([(1, "b", "1"), (1, "a", None), (1, "a", "2"), (3, "x", "y"), (None, "n", "n")], "id int, name string, value string")
    got = {r.id: [tuple(x) for x in r.inputs] for r in scans.with_values(ids, inputs=values).collect()}
    assert got == {1: [("a", None), ("a", "2"), ("b", "1")], 2: [], None: []}


def test_pages(spark):
    rows = spark.createDataFrame([(i * 7 % 25,) for i in range(25)], "k int").repartition(5)
    got = {r.k: r.page for r in scans.paged(["k"], 10, query=rows).collect()}
    assert got == {k: k // 10 for k in range(25)}
    assert scans.paged(["k"], 10, query=rows.limit(0), page=rows).count() == 0  # a query wins, even an empty one
    assert scans.paged(["k"], 10, page=rows).count() == 25
    for wrong in ({"size": 10}, {"size": 0, "query": rows}):
        with pytest.raises(ValueError):
            scans.paged(["k"], **wrong)


def test_listings(spark):
    rows = of_ledger(spark, (10, "k10", "order", None), (9, None, "order", None), (11, None, "order", None), (1, "k1", "customer", None))
    lines = lambda **how: [r.line for r in L.listing(rows, **how).orderBy("position").collect()]
    assert lines() == ["customer: 0 skipped", "order: 2 skipped", "  11", "  9"]
    assert lines(moved=True) == ["customer: 1 moved", "  1 -> k1", "order: 1 moved", "  10 -> k10"]
    assert L.listing(rows.limit(0)).count() == 0


def test_local_times(spark):
    noon = datetime.datetime(2024, 7, 1, 12, 0, 0, 5000)
    rows = spark.createDataFrame([(1, noon), (2, None), (3, datetime.datetime(2024, 3, 31, 1))], "i int, t timestamp_ntz")
    clock = lambda *zone: [r[0] for r in rows.orderBy("i").select(S.local_time(F.col("t"), *zone)).collect()]
    assert clock(F.lit("Europe/Berlin")) == [noon.replace(hour=14), None, datetime.datetime(2024, 3, 31, 3)]
    assert clock() == [noon, None, datetime.datetime(2024, 3, 31, 1)]


def test_unknown_files_are_an_error_where_asked(spark):
    rows = spark.createDataFrame([("a.BPMN20.xml",), ("b.dmn",), ("c.txt",), (None,)], "name string")
    kinds = lambda some, **how: [r[0] for r in some.select(S.file_kind(F.col("name"), **how)).collect()]
    assert kinds(rows) == ["process", "decision", None, None] and kinds(rows.where("name < 'c'"), strict=True) == ["process", "decision"]
    with pytest.raises(PySparkException, match="no diagram: c.txt"):
        kinds(rows.where("name = 'c.txt'"), strict=True)
    with pytest.raises(PySparkException, match="without name"):
        kinds(rows.where("name IS NULL"), strict=True)
