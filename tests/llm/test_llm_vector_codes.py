"""Codes against plain Lloyd's rounds over Python integers."""

import hashlib
import math
import random
from collections import defaultdict

from ferrylake.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, row string, V string, `a.b` int"


def reference(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = sorted(((i, v + [0] * (width * parts - len(v)), lab) for i, v, lab in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            by = defaultdict(list)
            for c in cut:
                by[nearest(p, c[p])[1]].append(c[p])
            for e, xs in by.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    done = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    by_label = defaultdict(int)
    for (_, _, lab), d in zip(kept, done, strict=True):
        by_label[lab] += sum(x for x, _ in d)
    return sorted(((i, "".join(f"{e:02x}" for _, e in d), sum(x for x, _ in d), by_label[lab], digest) for (i, _, lab), d in zip(kept, done, strict=True)), key=repr)


def rows(n=400, dim=8, seed=2):
    rng = random.Random(seed)
    some = [(i, [round(rng.gauss(rng.choice((-1, 0, 1)), 0.3), 3) for _ in range(dim)], rng.choice((1, 2, None))) for i in range(n)]
    hot = [0.25] * dim
    some += [(1000 + i, hot, 7) for i in range(n // 2)]
    some += [(5, [9.0] * dim, 1), (5, [-9.0] * dim, 1), (None, hot, None), (3000, None, 1), (3001, [1.0] * (dim - 1) + [None], 1), (3002, [float("nan")] * dim, 1), (3003, [float("-inf")] * dim, 1)]
    some += [some[0], (3004, [0.5] * 3, 2), (3005, [], 2)]
    return some


def frame(spark, some):
    f32 = [(i, v, lab, "r", "v", 1) for i, v, lab in some]
    return spark.createDataFrame(f32, SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def exact32(some):
    """Components as the floats of 32 bits that the table holds."""
    import struct

    return [(i, None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v], lab) for i, v, lab in some]


def test_equals_plain_rounds(spark, monkeypatch):
    some = rows()
    assert found(vc.vector_codes(frame(spark, some))) == reference(exact32(some))
    monkeypatch.setattr(vc, "SALT_ROWS", 16)
    few = rows(60, 4)
    assert found(vc.vector_codes(frame(spark, few))) == reference(exact32(few))


def test_only_members_that_change_move(spark):
    some = rows()
    coded, books, moved = vc.encode(frame(spark, some))
    n = coded.count()
    assert len(moved) == vc.ROUNDS - 1 and 0 < moved[0] < n * vc.PARTS and len(books) == vc.PARTS


def test_members_stay_under_one_partitioner(spark):
    lloyd = vc.Lloyd(vc.integers(frame(spark, rows())))
    before = lloyd.state
    lloyd.update()
    lloyd.migrate()
    assert lloyd.state.getNumPartitions() == before.getNumPartitions()
    assert lloyd.state._jrdd.rdd().partitioner().isDefined()


def test_few_and_no_vectors(spark):
    one = [(4, [0.5, -0.5, 0.25, 1.0], None)]
    assert found(vc.vector_codes(frame(spark, one))) == reference(exact32(one))
    assert vc.vector_codes(frame(spark, one).limit(0)).count() == 0
    huge = [(1, [3.0e38] * 4, 1), (2, [-3.0e38] * 4, 1), (3, [1.0] * 4, 1)]
    assert vc.vector_codes(frame(spark, huge)).select("error").distinct().count() == 1
