"""Repeated byte strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np
from llm_cases import SCHEMA, odd_rows

from ferrylake.llm import repeats

N = repeats.LENGTH


def reference(rows):
    """(doc_id, n_bytes, n_removed, n_spans, hash of the rest) by the smallest doc_id of each string."""
    least = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - N + 1) if doc_id is not None else ():
            s = b[i : i + N]
            least[s] = min(least.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - N + 1) if doc_id is not None else ():
            if least[b[i : i + N]] < doc_id:
                gone[i : i + N] = b"\1" * N
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed=5, docs=60):
    """Texts that share passages at all distances, periodic ones, edits in the middle of copies, and cuts in characters."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh é日") for _ in range(rng.choice((20, 49, 50, 51, 60, 200)))) for _ in range(25)]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice((rng.choice(pool), "".join(rng.choice("xyz ") for _ in range(rng.randrange(40))))) for _ in range(rng.randrange(12)))
        rows.append((rng.randrange(1000) if i % 7 else i % 5, text))
    rows += [(2000, "ab" * 200), (1999, "ab" * 60), (3000, "a" * 49), (3001, "a" * 50), (3002, "a" * 51), (3003, "a" * 400), (-5, pool[-1] * 3), (4000, pool[-1] * 3), (4000, pool[-1] * 3), (4000, None), (None, pool[-1] * 3), (4001, "")]
    return rows


def test_equals_the_dictionary_of_all_strings(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = reference(rows)
    assert sum(r[2] for r in want) > 1000 and found(repeats.digests(df)) == want


def test_frequent_grams_stretches_and_small_chunks(spark, monkeypatch):
    """The same result where all live grams count as very frequent, and where stretches and chunks end within texts."""
    rows = made(9)
    want = reference(rows)
    for name, value in (("MANY_CHUNKS", 1), ("STRETCH", 37), ("CHUNK", 300)):
        monkeypatch.setattr(repeats, name, value)
        chunks = [local_chunk(some) for some in (rows[:30], rows[30:])]
        assert sorted(local(chunks), key=repr) == want


def local_chunk(rows):
    body = [(t or "").encode() for _, t in rows]
    offsets = np.cumsum([0, *map(len, body)])
    return repeats.Chunk(np.array([i or 0 for i, _ in rows]), np.array([i is not None for i, _ in rows]), np.frombuffer(b"".join(body), np.uint8), offsets)


def local(chunks, owners=3):
    """All steps without Spark, so that patched constants are seen."""
    def dealt(pairs):
        by = {}
        for k, v in pairs:
            by.setdefault(k, []).append(v)
        return by

    asked = dealt(x for n, c in enumerate(chunks) for x in repeats.ask(n, n, c, owners))
    grades = {}
    for o, blobs in asked.items():
        for _, (_, name, owner, b) in repeats.grade(o, blobs):
            grades.setdefault(name, {})[owner] = repeats.unpacked(b)
    offered = [x for n, c in enumerate(chunks) for x in repeats.offer(n, n, c, grades.get(n, {}), owners)]
    spans = dealt((b[1], b[3]) for _, b in offered if b[2] is None)
    for blobs in dealt((o, b) for o, b in offered if b[2] is not None).values():
        for _, (_, name, b) in repeats.answer(blobs):
            spans.setdefault(name, []).append(b)
    for n, c in enumerate(chunks):
        for r in repeats.cut(c, spans.get(n, [])).to_pylist():
            yield r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(repeats.digests(df)) == reference([r[:2] for r in rows])
    clash = df.withColumnsRenamed({"kept": "TEXT", "score": "Doc_ID", "sketch": "spans"})
    assert found(repeats.digests(clash)) == reference([r[:2] for r in rows])
    assert repeats.digests(df.limit(0)).count() == 0


def test_spans_and_kept_bytes_make_up_the_text(spark):
    rows = made(11, 30)
    for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.n_bytes == len(r.kept) + sum(s.length for s in r.spans)
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_very_frequent_grams_are_not_sent_start_by_start(monkeypatch):
    """Runs of grams in very many chunks take about the bytes that they take elsewhere, with the same result."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    common = [" ".join(word() for _ in range(12)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(60))) for i in range(120)]
    chunks, sent = [local_chunk(some) for some in (rows[:60], rows[60:])], []

    def counted(*args, offer=repeats.offer):
        for x in offer(*args):
            sent[-1] += len(x[1][3])
            yield x

    monkeypatch.setattr(repeats, "offer", counted)
    for many in (1 << 30, 1):
        monkeypatch.setattr(repeats, "MANY_CHUNKS", many)
        sent.append(0)
        assert sorted(local(chunks), key=repr) == reference(rows)
    assert sent[1] < 2.2 * sent[0]


def test_owners_look_at_runs_in_parts(monkeypatch):
    rows = made(13)
    monkeypatch.setattr(repeats, "LOOKED_AT", 500)
    assert sorted(local([local_chunk(some) for some in (rows[:25], rows[25:])]), key=repr) == reference(rows)
