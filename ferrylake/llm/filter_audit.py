"""Interaction audit of filters: what each filter removes, in every order, and its Shapley value, for each part of a corpus.

Every document gets the set of filters that it fails, as bits. Documents are counted by part and set, so at most 32 rows a
part go on; from them come the removals of all 32 coalitions of filters. A step of an order removes the difference of two
coalitions. Shapley values are the solution of Shapley's own least squares: the additive game nearest to the removals in
the kernel's weights, under the condition that all five add up to the removals of all. Its normal equations are solved
once, in rationals, for every coalition's unit game; the solution is linear in the removals, so each part's values are
integer sums of its coalitions.

Null texts count as empty; an empty text fails A, and E where a smaller doc_id has an empty text, too. A null lang is the
part of the empty string. A row without doc_id has no label, never fails E, and fails no other row. Repeated rows count as often
as they are there and don't fail E through one another, since their doc_id is not smaller. Repeated labels of a doc_id: one
that holds is enough. An empty table gives no part, so no row. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import exact, staged, text_bytes, text_slices, word_hashes

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = factorial(len(FILTERS))
_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*|")] = True


def solve(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """The right-hand columns after the square left side of `rows` became the identity."""
    n = len(rows)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_weights(players: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each player the factor of every coalition's value; the empty coalition's value is 0.

    Least squares over the coalitions that are neither empty nor whole, weighted by the kernel, with one Lagrange
    multiplier for the condition that the values add up to that of the whole.
    """
    whole = (1 << players) - 1
    kernel = {s: Fraction(players - 1, comb(players, k) * k * (players - k)) for s in range(1, whole) if (k := s.bit_count())}
    rows = []
    for i in range(players):
        left = [sum(w for s, w in kernel.items() if s >> i & s >> j & 1) for j in range(players)] + [Fraction(1)]
        rows.append(left + [kernel[s] if s in kernel and s >> i & 1 else Fraction(0) for s in range(whole + 1)])
    rows.append([Fraction(1)] * players + [Fraction(0)] + [Fraction(s == whole) for s in range(whole + 1)])
    return solve(rows)[:players]


def judged(column: pa.Array) -> Iterator[tuple[bytes, int]]:
    """SHA-256 of each text, and the bits of A to D that it fails. Words are told apart by hashes of 64 bits within a text."""
    raw, offsets = text_bytes(column)
    words, first = word_hashes(raw, offsets, lower=False)
    sums = {c: np.concatenate([[0], np.cumsum(x)]) for c, x in (("capitals", (raw >= 0x41) & (raw <= 0x5A)), ("points", (raw & 0xC0) != 0x80), ("odd", _ODD[raw]))}
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = np.sort(words[first[i] : first[i + 1]])
        n, kinds = len(own), int(len(own) > 0) + int(np.count_nonzero(own[1:] != own[:-1]))
        capitals, points, odd = (int(sums[c][b] - sums[c][a]) for c in ("capitals", "points", "odd"))
        failed = (n < 100, 100 * kinds < 80 * n, 100 * capitals > 10 * points, odd > 0)
        yield hashlib.sha256(raw[a:b]).digest(), sum(f << k for k, f in enumerate(failed))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the bits of A to D that each document fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in text_slices(b.column(2)):
                found = list(judged(b.column(2).slice(at, end - at)))
                ids, parts = (b.column(k).slice(at, end - at) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, parts, pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.int32())], ["doc_id", "part", "digest", "bits"])

    rows = exact(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, bits int")


def sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (of A to E), n, good, toxic: documents counted by the set of filters that they fail.

    Rows are counted by doc_id, where they meet their labels, then by digest and part, so copies meet as a few counted rows.
    """
    marked = exact(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    one = failures(docs).groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n")).join(marked, "doc_id", "left")
    one = one.select("doc_id", "part", "digest", "bits", "n", F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))
    first = F.struct("doc_id", "n", "good", "toxic")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    # Of each (digest, part): all rows, those of the smallest doc_id, and those without one.
    by = one.groupBy("digest", "part", "bits").agg(*sums, F.min(F.when(F.col("doc_id").isNotNull(), first)).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    by = staged(by, "audit")
    least = F.min("first.doc_id").alias("least")
    lows = by.groupBy("digest").agg(least, F.count("*").alias("parts"))
    # A text of one part is its own least; only texts in several parts meet the others.
    several = by.join(lows.where("parts > 1").select("digest", "least"), "digest", "left").withColumn("mine", F.col("least").isNull() | (F.col("first.doc_id") == F.col("least")))
    passing = {c: F.when(F.col("mine"), F.coalesce(F.col(f"first.{c}"), F.lit(0))).otherwise(0) for c in ("n", "good", "toxic")}
    passing["n"] = passing["n"] + F.col("free")
    e = 1 << FILTERS.index("E")
    both = several.select("part", "bits", *(F.col(c) for c in ("n", "good", "toxic")), *(x.alias(f"p_{c}") for c, x in passing.items()))
    split = F.explode(F.array(F.struct("bits", *(F.col(f"p_{c}").alias(c) for c in passing)), F.struct((F.col("bits") + e).alias("bits"), *((F.col(c) - F.col(f"p_{c}")).alias(c) for c in passing))))
    return both.select("part", split.alias("x")).select("part", "x.*").where("n > 0").groupBy("part", "bits").agg(*sums)


def steps() -> str:
    """All orders and their steps as JSON: the coalition before, after, and the filter alone."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append({"o": "".join(FILTERS[i] for i in order), "s": k + 1, "b": before, "a": before | 1 << f, "f": f})
            before |= 1 << f
    return json.dumps(out)


def audit(counted: DataFrame) -> DataFrame:
    """The report of `sets`: one row for each part, order and step."""
    hit = lambda s, c: F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(s) != 0, F.col(c))), F.lit(0)).cast("long")
    tables = {c: F.array(*(hit(s, c) for s in range(ALL + 1))).alias(f"v_{c}") for c in ("n", "good", "toxic")}
    parts = counted.groupBy("part").agg(F.sum("n").cast("long").alias("total"), *tables.values())
    weights = [[int(w * ORDERS) for w in row] for row in shapley_weights()]
    value = lambda row: sum((F.col("v_n")[s] * w for s, w in enumerate(row) if w), F.lit(0).cast("long"))
    parts = parts.withColumn("shapley", F.array(*map(value, weights)))
    step = F.explode(F.from_json(F.lit(steps()), "array<struct<o string, s int, b int, a int, f int>>"))
    rows = parts.select("*", step.alias("x")).select("*", "x.*")
    v = lambda s, c="n": F.col(f"v_{c}")[s]
    removed = v(F.col("a")) - v(F.col("b"))
    own = F.expr("shiftleft(1, f)")
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), (F.col("total") - v(F.col("a"))).alias("kept"), removed.alias("removed"), (v(own) - removed).alias("redundant"),
        (v(F.lit(ALL)) - v(F.lit(ALL) - own)).alias("unique_fails"), (v(F.col("a"), "good") - v(F.col("b"), "good")).alias("good_lost"), (v(F.col("a"), "toxic") - v(F.col("b"), "toxic")).alias("toxic_lost"), F.col("shapley")[F.col("f")].alias("shapley"),
    )


#: The same result in plain SQL: every order is walked through, and Shapley values are sums of steps.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
k AS (SELECT * FROM (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')) AS k(i, x)),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS o, p.x || q.x || r.x || s.x || u.x AS name FROM k AS p, k AS q, k AS r, k AS s, k AS u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
z AS (SELECT name, j AS step, o[j] AS i, list_sum(list_transform(o[1:j], lambda x: (1 << x)::BIGINT))::BIGINT AS after, coalesce(list_sum(list_transform(o[1:j - 1], lambda x: (1 << x)::BIGINT)), 0)::BIGINT AS before FROM o, range(1, 6) AS r(j)),
g AS (SELECT part, name AS filter_order, step, i, sum(n) FILTER (bits & after = 0) AS kept, sum(n) FILTER (bits & before = 0 AND bits & (1 << i) <> 0) AS removed,
  sum(n) FILTER (bits & before <> 0 AND bits & (1 << i) <> 0) AS redundant, sum(n) FILTER (bits = 1 << i) AS unique_fails,
  sum(good) FILTER (bits & before = 0 AND bits & (1 << i) <> 0) AS good_lost, sum(toxic) FILTER (bits & before = 0 AND bits & (1 << i) <> 0) AS toxic_lost FROM m, z GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM g"""


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(sets(docs, labels))
