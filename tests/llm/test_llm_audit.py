"""The audit against walking every document through every order, and its rationals against plain Shapley values."""

from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

from llm_cases import SCHEMA, WORD, odd_rows

from ferrylake.llm import filter_audit as fa


def fails(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": doc_id is not None and first[t] < doc_id}
        yield doc_id, lang or "", f


def reference(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = list(fails(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                removed = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                shapley[part, x] += len(removed)
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                out[part, order, k + 1] = (len(left), len(removed), sum(f[x] for _, f in own) - len(removed), alone, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_walking_all_orders(spark):
    long = " ".join(f"Word{i % 90}" for i in range(100))
    rows = [tuple(r) for r in odd_rows()]
    more = [(200, long, "de"), (150, long, None), (150, long, None), (None, long, "de"), (201, long + " 5%", ""), (202, "A B C " * 60, "fr"), (203, " ".join(f"u{i}" for i in range(120)), "fr"), (204, "", "fr"), (-9, "", "xx")]
    rows += [(*r, None, None, None, None, None, None, None) for r in more]
    labels = [(200, 1, 0), (200, 0, 1), (150, 1, 1), (3, 1, None), (None, 1, 1), (202, 0, 1), (204, 1, 0), (999, 1, 1)]
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = reference(rows, labels)
    assert found(fa.filter_audit(df, marks)) == want
    clash = df.withColumnsRenamed({"kept": "TEXT", "score": "part", "sketch": "bits"})
    assert found(fa.filter_audit(clash, marks.selectExpr("*", "1 AS QUALITY2", "2 AS n"))) == want
    assert fa.filter_audit(df.limit(0), marks).count() == 0
    assert sum(x[4] for x in found(fa.filter_audit(df, marks.limit(0))).values()) == 0


def test_least_squares_are_shapley_values():
    for n in (2, 3, 5):
        for i, row in enumerate(fa.shapley_weights(n)):
            for s in range(1, 1 << n):
                k = s.bit_count()
                plain = Fraction(factorial(k - 1) * factorial(n - k), factorial(n)) if s >> i & 1 else -Fraction(factorial(k) * factorial(n - k - 1), factorial(n))
                assert row[s] == plain
