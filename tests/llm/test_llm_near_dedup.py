import random

import numpy as np
import pytest
from llm_cases import SCHEMA, near_reference, odd_rows

from ferrylake.llm import near_dedup


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_documents_against_all_pairs(spark, small, k):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert got(near_dedup.near_duplicates(docs, k)) == near_reference([(r.doc_id, r.text) for r in docs.collect()], k, 80)


def test_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(near_dedup.near_duplicates(docs, 2)) == near_reference([(r[0], r[1]) for r in rows], 2, 80)
    kept = near_dedup.deduplicate(docs, 2)
    assert kept.columns == docs.columns
    # rows that repeat an id with another text are documents of their own
    texts = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=repr)
    stay = [c for _, _, c in near_reference([(i, t) for i, (_, t) in enumerate(texts)], 2, 80)]
    groups = {}
    for i, c in enumerate(c for _, c in sorted((d, c) for d, _, c in near_reference([(i, t) for i, (_, t) in enumerate(texts)], 2, 80))):
        groups.setdefault(c, []).append(texts[i])
    mine = [(r.doc_id, r.text) for r in kept.where("doc_id IS NOT NULL").collect()]
    assert len(mine) == len(groups) == len(set(stay)) and all(sum(m in g for m in mine) == 1 for g in groups.values())


def test_repeated_ids_with_other_texts_all_stay(spark):
    rows = [(5, "a b c d"), (5, "p q r s"), (5, "p q r s"), (6, "p q r s"), (7, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        assert sorted(t for _, t in near_dedup.deduplicate(docs, 2).collect()) == ["a b c d", "p q r s", "x y z"]


def test_two_in_a_home_that_neither_leads(spark):
    """Pivots that live in other homes: groups around drifting originals, all links against brute force."""
    rng = random.Random(9)
    rows = []
    for g in range(12):
        w = [f"g{g}x{rng.randrange(400)}" for _ in range(60)]
        for _ in range(14):
            w = list(w)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(60)] = f"g{g}y{rng.randrange(400)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(docs, 2)) == near_reference(rows, 2, 80)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_and_chain_lose_no_link(spark):
    """More near copies than a block holds, at all similarities around the threshold, and a chain linked only by neighbours."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
        rows.append((1000 - i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):
        chain[i * 3] = f"d{i}"
        rows.append((2000 + i, " ".join(chain)))
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == near_reference(rows, 2, 80)


def test_repeated_ids_tie_their_classes(spark):
    rows = [(1, "a b c"), (2, "d e f"), (3, "a b c"), (3, "d e f"), (4, "x y")]
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == near_reference(rows, 2, 80)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        a, b = np.sort(pool[:3000]), np.sort(np.concatenate([pool[: int(3000 * share)], pool[3000 : 6000 - int(3000 * share)]]))
        s = near_dedup.sketches([np.unique(a * np.uint64(2)), np.unique(b * np.uint64(2))])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.15
