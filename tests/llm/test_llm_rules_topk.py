from collections import Counter

import numpy as np
import pytest
from llm_cases import SCHEMA, WORD, odd_rows
from oracle import connect, differences

from ferrylake.llm import exact_topk, queries, quality_rules


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_oracle(spark, small, name):
    assert differences(queries.queries()[name](spark, small), queries.oracle_sql()[name], connect(small)) == ""


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rules_count_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(50, "a b c\n" * 40), (51, "#x $y\n\nfoo & <bar>\n#x $y"), (52, "a b c d a b c")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()), key=repr)
    wanted = sorted(((d, *(c := counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for d, t in rows), key=repr)
    assert found == wanted
    assert all(not r.kept for r in got.where("base_failed").collect())


def test_rules_keep_other_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out = quality_rules.quality_rules(docs)
    assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert dict(out.dtypes)["kept"] == "boolean"
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_topk_against_all_scores(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 8))
    v[100:160] = v[100]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(9001, None), (9002, []), (9003, [1.0, None]), (9004, [float("nan")] * 8), (9005, [float("inf")] * 8), (9006, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df.where("vec_id % 100 = 0 OR vec_id > 9000"), df, 5).collect()
    q = np.floor(256 * v).astype(np.int64)
    wanted = []
    for i in range(0, 3000, 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:5]
        wanted += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(wanted)


def test_topk_with_few_or_no_candidates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_topk.top_k(df.where("vec_id = 1"), df, 5).collect()] == [(1, 1, 2, 256 * 128 + 512 * 128)]
    assert exact_topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_topk_in_groups_of_blocks_and_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_topk, "GROUP", 2)
    monkeypatch.setattr(exact_topk, "BLOCK", 150)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(40, 6)), 30, axis=0) + rng.normal(size=(1200, 6)) * 0.1
    ids = np.arange(1200)
    ids[500:900] = 7  # a third of all rows under one id
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(ids, v, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = exact_topk.top_k(df.where("vec_id % 10 = 0"), df, 5).collect()
    q = np.floor(256 * v).astype(np.int64)
    wanted = []
    for i in range(0, 1200, 10):
        if ids[i] == i:
            s = q @ q[i]
            wanted += [(i, k + 1, int(ids[j]), int(s[j])) for k, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != i][:5])]
    assert sorted(tuple(r) for r in got) == sorted(wanted)
