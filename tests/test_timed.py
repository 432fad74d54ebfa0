"""As-of joins against brute force, and a drain that is killed and started again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferrylake.operators.asof import as_of, form_versions
from ferrylake.operators.ledger_table import LedgerTable
from ferrylake.operators.pipeline import Pipeline, Rule
from ferrylake.sources import sinks
from ferrylake.streaming.drain import drain_into


def test_as_of_with_a_hot_key_ties_and_gaps(spark):
    rng, t0 = random.Random(6), datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(hours=rng.randrange(0, 24 * 200, 7))
    key = lambda: rng.choice(("hot", "hot", "a", "b", None))
    versions = [(key(), when(), i) for i in range(150)] + [("late", t0 + timedelta(days=300), 999), ("a", None, 5)]
    asks = [(i, key(), when()) for i in range(300)] + [(900, "late", t0), (901, "a", None), (902, "none", t0), (903, "hot", t0 - timedelta(days=900)), (904, "hot", t0 + timedelta(days=900))]
    want = {}
    for i, k, at in asks:
        seen = [(t, v) for kk, t, v in versions if k is not None and kk == k and t is not None and at is not None and t <= at]
        want[i] = max(seen)[1] if seen else None
    a, v = spark.createDataFrame(asks, "i int, k string, at timestamp_ntz"), spark.createDataFrame(versions, "k string, created timestamp_ntz, v int")
    for days in (1, 30, 10_000):
        got = as_of(a, v, "k", "at", "created", "v", days).collect()
        assert len(got) == len(asks) and {r.i: r.v for r in got} == want


def test_bindings(spark):
    t = datetime(2024, 1, 1)
    versions = spark.createDataFrame([("f", t, 1, "d1", None, 10), ("f", t + timedelta(days=40), 2, "d2", "x", 11), ("f", t + timedelta(days=90), 3, "d2", "x", 12)], "form string, created timestamp_ntz, version int, deployment string, tag string, form_id int")
    asks = [(1, "latest", None, 50), (2, "latest", None, -1), (3, "deployment", "d2", 0), (4, "version", "1", 0), (5, "versionTag", "x", 0), (6, "versionTag", "y", 0), (7, "other", "x", 0), (8, None, None, 0), (9, "version", None, 0)]
    rows = spark.createDataFrame([(i, "f", b, w, t + timedelta(days=n)) for i, b, w, n in asks], "i int, form string, binding string, wanted string, at timestamp_ntz")
    got = {r.i: (r.form_id, r.outcome) for r in form_versions(rows, versions).collect()}
    assert got == {1: (11, "found"), 2: (None, "missing"), 3: (12, "found"), 4: (10, "found"), 5: (12, "found"), 6: (None, "missing"), 7: (None, "unknown binding"), 8: (None, "unknown binding"), 9: (None, "missing")}


def test_a_drain_that_dies_and_starts_again_counts_each_row_once(spark, tmp_path, monkeypatch):
    spec = Pipeline("job", "id", None, (Rule("id % 3 = 0", "is odd"),))
    source = f"file://{tmp_path}/in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 14).write.mode("append").parquet(source)
    how = {"counter": lambda x: x.cast("long"), "drawn": F.lit(1), "per_trigger": 1}
    schema = spark.range(1).schema

    def ends(name, fails_at=None, before_pointer=False):
        ledger, dead = LedgerTable(spark, f"file://{tmp_path}/{name}"), []

        def die(number):
            if number == fails_at and not dead:
                dead.append(number)
                raise RuntimeError("killed")

        real = sinks.publish

        def half(df, at, as_name=None):
            if before_pointer and not dead and as_name.endswith("-1"):
                dead.append(1)
                df.write.parquet(f"{at}/{as_name}")
                raise RuntimeError("killed")
            return real(df, at, as_name)

        monkeypatch.setattr("ferrylake.operators.ledger_table.publish", half)
        run = lambda: drain_into(spark, source, schema, LedgerTable(spark, ledger.path), spec, f"{ledger.path}-state", after=die, **how)
        if fails_at is not None or before_pointer:
            with pytest.raises(Exception, match="killed"):
                run()
        run()
        return sorted(tuple(r) for r in LedgerTable(spark, ledger.path).read("job").collect())

    clean = ends("clean")
    assert len(clean) == 34 and sum(r[1] is None for r in clean) == 12
    assert ends("killed", fails_at=1) == clean
    assert ends("half", before_pointer=True) == clean


def test_archives_take_null_and_repeated_names(spark):
    import io
    import zipfile

    files = spark.createDataFrame([("a.xml", b"1"), ("a.xml", b"2"), (None, b"3"), ("b", None)], "filename string, content binary")
    got = sinks.zip_batch(files, 10).collect()
    names = sorted(n for r in got for n in zipfile.ZipFile(io.BytesIO(r.archive)).namelist())
    assert names == ["a-2.xml", "a.xml", "b", "unnamed"]
