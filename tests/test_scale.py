"""What keeps queries within limits on larger tables: joins that are not broadcast, rows that are dealt out."""

import os

from ferrylake.operators import identity
from ferrylake.operators import pipeline as P
from ferrylake.operators.ledger_table import LedgerTable
from ferrylake.operators.pipeline import Pipeline, Rule
from ferrylake.plans import diagrams, trees
from ferrylake.sources import scans
from ferrylake.sources.staging import shared_dir
from oracle import connect, differences


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_priority_scopes_broadcasts_no_nodes(spark, small):
    found = diagrams.priority_scopes(spark, small)
    assert "Broadcast" not in plan(found)
    assert not differences(found, diagrams.PRIORITY_SCOPES, connect(small))


def test_validation_broadcasts_no_models_and_no_verdicts(spark, small):
    assert "Broadcast" not in plan(trees.instance_validation(spark, small))


def test_documents_of_a_small_file_are_dealt_out(spark, small):
    made = diagrams.diagrams(spark, small)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert scans.spread(spark.range(11), 2).rdd.getNumPartitions() == 6 and scans.spread(spark.range(11), 2).count() == 11


def test_history_writes_and_joins_no_more_than_it_needs(spark, small, tmp_path):
    source = spark.createDataFrame([(2, "b", 5), (1, "a", 7), (1, "a", 3), (None, "c", 1)], "id int, src_id string, v int")
    spec = Pipeline("form definition", "id", None, (Rule("v > 4", "too large"),), ("src_id",))
    ledger = LedgerTable(spark, str(tmp_path / "ledger"))
    rows = P.tried(source, ledger, spec, counter=lambda x: x.cast("long"))
    assert "Join" not in plan(rows) and plan(rows).count("Exchange") == 1
    assert sorted((r.src_id, r.skip_reason, r.own.v, r.own.src_id) for r in rows.collect()) == [("1", None, 3, "a"), ("2", "too large", 5, "b")]
    staged, counts = set(staged_folders(spark)), {}
    P.run({"form definition": source}, ledger, [spec], counts=counts, counter=lambda x: x.cast("long"))
    assert counts == {"form definition": (1, 1)} and set(staged_folders(spark)) == staged
    assert sorted((r.src_id, r.tgt_key is None) for r in ledger.read("form definition").collect()) == [("1", False), ("2", True)]


def staged_folders(spark):
    at = shared_dir(spark).removeprefix("file://")
    return [x for x in os.listdir(at) if x.startswith("tried-")]


def test_pairs_of_a_deployment_are_not_shuffled(spark):
    auth = spark.createDataFrame([(1, "d"), (1, "d"), (2, "d"), (2, "e"), (None, "d"), (None, "e"), (3, None), (4, "x")], "id int, resource_id string")
    resources = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("e", "a"), (None, "z")], "deployment string, resource_key string")
    found = identity.by_deployment(auth, resources)
    assert sorted((r.id or 0, r.resource_id) for r in found.collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (2, "b")]
    top = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert top[0].startswith("Union") and top[1].startswith(":- Project")  # before: an Aggregate over all pairs


def sent(df):
    """Rows that all exchanges of a plan wrote."""
    df.collect()
    left, total = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        x = left.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(x.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(x.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += x.metrics().apply("shuffleRecordsWritten").value()
            left += [x.children().apply(i) for i in range(x.children().size())]
    return total


def test_keys_of_a_deployment_are_not_copied_to_each_task(spark):
    auth = spark.range(100).selectExpr("cast(id AS int) AS id", "cast(id % 50 AS string) AS resource_id")
    resources = spark.range(2000).selectExpr("cast(id % 50 AS string) AS deployment", "concat('k', id) AS resource_key")
    found = identity.by_deployment(auth, resources)
    assert sent(found) < 8_000  # 10,300 with a copy for each of 4 tasks, and more with more tasks
    assert found.count() == found.distinct().count() == 4_000


def test_pairs_of_a_large_deployment_are_dealt_as_a_grid(spark, monkeypatch):
    monkeypatch.setattr(identity, "PAIRS", 40)
    monkeypatch.setattr(identity, "KEYS", 4)
    auth = spark.range(60).selectExpr("IF(id = 7, NULL, id) AS id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 2 > 0 THEN 'b' ELSE 'c' END AS resource_id").union(spark.createDataFrame([(1, "b"), (2, "b")], "id long, resource_id string"))
    resources = spark.range(30).selectExpr("IF(id % 5 > 0, 'hot', 'b') AS deployment", "IF(id < 2, NULL, concat('k', id % 20)) AS resource_key")
    for keys in (resources, resources.selectExpr("deployment", "array(resource_key) AS resource_key")):
        got = identity.by_deployment(auth, keys)
        assert "_wide" in plan(got)
        want = auth.alias("a").join(keys.alias("k"), auth.resource_id == keys.deployment).select("id", "resource_key").distinct().collect()
        assert sorted(map(str, got.collect())) == sorted(str(r).replace("resource_key", "resource_id") for r in want) and len(want) > 400


def test_instances_meet_their_models_in_one_row(spark, small):
    assert sent(trees.instance_validation(spark, small)) < 20_000  # before: a row for each active node, and 16 copies of each verdict
