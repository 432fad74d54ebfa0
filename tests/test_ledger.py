"""The ledger's pipeline: one row an id, own columns, keys, chains, folders by type."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ferrylake.operators import pipeline as P
from ferrylake.operators.chains import distinct_numbers, resolve_chains
from ferrylake.operators.ledger_table import LedgerTable
from ferrylake.operators.pipeline import Parent, Pipeline, Rule
from ferrylake.schemas import COUNTER_BITS, HISTORY_PARTITION, LEDGER
from ferrylake.sources import sinks

INSTANCE = Pipeline("process instance", "id", None, (Rule("state = 'bad'", "is bad"), Parent("parent", "parent", "process instance", "parent missing", "parent IS NOT NULL")), partition_of="parent")


def empty(spark):
    return spark.createDataFrame([], LEDGER)


def test_a_repeated_id_is_one_row(spark):
    source = spark.createDataFrame([("a", "x", None), ("a", "bad", None), ("a", "x", None), (None, "x", None), ("b", "x", "a")], "id string, state string, parent string")
    first = P.run({"process instance": source}, empty(spark), [INSTANCE])
    assert sorted((r.src_id, r.skip_reason) for r in first.collect()) == [("a", "is bad"), ("b", "parent missing")]
    again = P.run({"process instance": source}, first, [INSTANCE], retry=True)
    assert again.count() == 2
    ordered = Pipeline("process instance", "id", None, (Rule("state = 'bad'", "is bad"),), ("rank",))
    rows = spark.createDataFrame([("a", "bad", 2), ("a", "x", 1)], "id string, state string, rank int")
    assert P.run({"process instance": rows}, empty(spark), [ordered]).first().skip_reason is None


def test_own_columns_of_any_name_stay(spark):
    names = ["skip_reason", "tgt_key", "partition_id", "src_id", "parent_key", "own", "x", "o", "part", "number", "k0", "c0", "p1", "time"]
    source = spark.createDataFrame([("a", "x", None, *range(len(names))), ("b", "x", "a", *range(len(names)))], "id string, state string, parent string, " + ", ".join(f"{n} int" for n in names))
    done = P.tried(source, empty(spark), INSTANCE)
    for r in done.collect():
        assert [r.own[n] for n in names] == list(range(len(names)))
    keys = {r.src_id: (r.tgt_key, r.parents.parent) for r in done.collect()}
    assert keys["a"][0] == keys["b"][1] and keys["a"][0] != keys["b"][0]
    assert P.moved(done).columns == ["tgt_key", "partition_id", "create_time", "parents", "own"]


def test_numbers_never_collide(spark):
    ids = spark.createDataFrame([(f"i{k}",) for k in range(120)] + [("i3",), (None,)], "id string")
    taken = spark.createDataFrame([(k,) for k in range(0, 256, 5)], "number long")
    got = {r.id: r.number for r in distinct_numbers(ids, "id", "s", 256, taken).collect()}
    assert len(got) == len(set(got.values())) == 120 and all(0 <= n < 256 and n % 5 for n in got.values())
    assert got == {r.id: r.number for r in distinct_numbers(ids.repartition(3), "id", "s", 256, taken).collect()}
    with pytest.raises(ValueError):
        distinct_numbers(ids, "id", "s", 170, taken)
    assert distinct_numbers(ids.limit(0), "id", "s", 256).count() == 0


def test_keys_are_unique_across_runs_and_in_range(spark):
    rows = lambda a, b: spark.range(a, b).selectExpr("CAST(id AS string) AS id", "'x' AS state", "CAST(null AS string) AS parent")
    first = P.run({"process instance": rows(0, 300)}, empty(spark), [INSTANCE])
    both = P.run({"process instance": rows(0, 500)}, first, [INSTANCE])
    keys = [int(r.tgt_key) for r in both.collect()]
    assert len(set(keys)) == len(keys) == 500
    assert all(HISTORY_PARTITION << COUNTER_BITS <= k < HISTORY_PARTITION + 1 << COUNTER_BITS for k in keys)


def test_a_chain_of_ten_thousand_in_one_run(spark):
    n = 10_000
    k = F.col("id")
    source = spark.range(n).select(k.cast("string").alias("id"), F.when(k == n - 50, "bad").otherwise("x").alias("state"), F.when(k > 0, (k - 1).cast("string")).alias("parent"), k.alias("rank"))
    done = P.run({"process instance": source}, empty(spark), [INSTANCE], drawn=F.col("rank") + 7)
    by = {r["skip_reason"]: r["n"] for r in done.groupBy("skip_reason").agg(F.count("*").alias("n")).collect()}
    assert by == {None: n - 50, "is bad": 1, "parent missing": 49}
    assert [r[0] for r in done.where("tgt_key IS NOT NULL").select("partition_id").distinct().collect()] == [7]


def test_cycles_gaps_and_parents_that_moved_before(spark):
    links = [("a", None, True, 1), ("b", "a", True, 0), ("c", "b", False, 0), ("d", "c", True, 0), ("e", "gone", True, 0), ("f", "e", True, 0), ("x", "y", True, 0), ("y", "x", True, 0), ("z", "y", True, 0), ("s", "s", True, 0), ("n", None, None, 3)]
    got = {r.id: (r.good, r.part) for r in resolve_chains(spark.createDataFrame(links, "id string, up string, good boolean, part int")).collect()}
    assert {i for i, (good, _) in got.items() if good} == {"a", "b"} and got["b"] == (True, 1) and len(got) == len(links)
    old = spark.createDataFrame([("p", "77", "process instance", datetime(2024, 1, 1), None, 5)], LEDGER)
    source = spark.createDataFrame([("q", "x", "p"), ("r", "x", "q"), ("t", "x", "nobody")], "id string, state string, parent string")
    done = {r.src_id: (r.skip_reason, r.partition_id) for r in P.run({"process instance": source}, old, [INSTANCE]).collect()}
    assert done == {"p": (None, 5), "q": (None, 5), "r": (None, 5), "t": ("parent missing", None)}


def test_one_run_ends_where_retries_would(spark):
    n = 32
    source = spark.range(n).selectExpr("CAST(id AS string) AS id", "IF(id % 9 = 8, 'bad', 'x') AS state", "IF(id % 16 = 0, null, CAST(id - 1 AS string)) AS parent")
    once = P.run({"process instance": source}, empty(spark), [INSTANCE])
    ledger = LedgerTable.of(once, P.shared_dir(spark) + "/fixpoint")
    assert P.run({"process instance": source}, ledger, [INSTANCE], retry=True).exceptAll(once).isEmpty()
    fixed = P.run_to_fixpoint({"process instance": source}, empty(spark), [INSTANCE])
    assert fixed.exceptAll(once).isEmpty() and once.exceptAll(fixed).isEmpty()


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_type_reads_and_writes_its_own_folder(spark, tmp_path):
    ledger = LedgerTable(spark, f"file://{tmp_path}/ledger")
    task = Pipeline("user task", "id", None, (Parent("instance", "instance", "process instance", "instance missing"),))
    source = spark.createDataFrame([("a", "x", None)], "id string, state string, parent string")
    P.run({"process instance": source}, ledger, [INSTANCE])
    before = files(tmp_path)
    tasks = spark.createDataFrame([("t", "a"), ("u", "b")], "id string, instance string")
    done = P.run({"user task": tasks}, ledger, [task])
    added = files(tmp_path) - before
    assert added and all("type=user-task" in f for f in added) and before <= files(tmp_path)
    assert sorted((r.src_id, r.type, r.skip_reason) for r in done.collect()) == [("a", "process instance", None), ("t", "user task", None), ("u", "user task", "instance missing")]
    reread = LedgerTable(spark, f"file://{tmp_path}/ledger")
    assert {"type=user-task"} == {p for f in reread.read("user task").inputFiles() for p in f.split("/") if p.startswith("type=")}
    twice = reread.read("user task").unionByName(reread.read("user task"))
    with pytest.raises(ValueError, match="twice"):
        reread.upsert("user task", twice)
    with pytest.raises(ValueError, match="no type"):
        LedgerTable.of(done.withColumn("type", F.lit("other")), f"file://{tmp_path}/x")


def test_a_run_that_dies_before_its_pointer_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    source = lambda *ids: spark.createDataFrame([(i, "x", None) for i in ids], "id string, state string, parent string")
    P.run({"process instance": source("a")}, LedgerTable(spark, path), [INSTANCE])
    real = sinks.publish

    def dies(df, at, name=None):
        df.write.parquet(f"{at}/snapshot-lost")
        raise RuntimeError("lost")

    monkeypatch.setattr("ferrylake.operators.ledger_table.publish", dies)
    with pytest.raises(RuntimeError):
        P.run({"process instance": source("a", "b")}, LedgerTable(spark, path), [INSTANCE])
    assert LedgerTable(spark, path).read("process instance").count() == 1
    monkeypatch.setattr("ferrylake.operators.ledger_table.publish", real)
    assert P.run({"process instance": source("a", "b")}, LedgerTable(spark, path), [INSTANCE]).count() == 2
