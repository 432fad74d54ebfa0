"""Quality classifier by co-training of a text-content view and a page-metadata view.

Each view has its own logistic regression. In every round each view scores all unlabelled documents and hands those that it
is sure of to the other view as pseudo-labels. In the end both views are calibrated on labelled rows that neither learned
from, and all documents get the combination of the two calibrated log odds.

The text view reads counts of character classes, repetition of words and of three-word windows, and hashed word
frequencies; the metadata view reads language, source and length. Fitting takes at most FIT_ROWS labelled rows, in order of a
hash of their ids, and every other document: their features are written once, and each Newton step sums gradients and Hessians
over the partitions. However many pseudo-labels of a class there are, together they weigh as much as HANDED a round would.
Scoring covers every document, whole.

Null or empty texts have zero counts; null languages and sources are values of their own. Where the labels don't have both
classes, every document scores 1. Repeated rows score alike. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylake.llm.common import exact, staged, text_bytes, text_slices, word_hashes
from ferrylake.llm.common import mix as mixed

FIT_ROWS = 8000
ROUNDS = 3
#: A view hands on all pseudo-labels that it is this sure of; those of a class weigh as much as so many a round at most.
SURE, HANDED = 0.97, 400
#: Sums of partitions meet in so many tasks before they reach the driver.
MEETINGS = 8
#: Weight of a pseudo-label beside a label.
PSEUDO_WEIGHT = 0.3
WORD_CELLS, META_CELLS = 256, 128
THRESHOLD = 0.5
SHAPE = 12

#: Byte classes: 1 upper case, 2 digits, 3 symbols, 4 exclamation marks, 5 other punctuation, 6 line ends, 7 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 1, 2
_CLASS[[ord(c) for c in "\"'(),-./:;?[]_`{}~"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>@\\^+="]] = 3
_CLASS[ord("!")], _CLASS[0x0A], _CLASS[0x80:] = 4, 6, 7


def text_features(column: pa.Array) -> np.ndarray:
    """One row of SHAPE ratios and WORD_CELLS word frequencies for each text."""
    raw, offsets = text_bytes(column)
    rows = len(offsets) - 1
    out = np.zeros((rows, SHAPE + WORD_CELLS), np.float32)
    if not len(raw):
        return out
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    classes = np.bincount(row * 8 + _CLASS[raw], minlength=rows * 8).reshape(rows, 8)
    h, first = word_hashes(raw, offsets)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        three = mixed(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else h[:0]
    out[:, :7] = classes[:, 1:] / size[:, None]
    out[:, 7] = np.log1p(n)
    out[:, 8] = size / np.maximum(n, 1) / 10
    for i in np.flatnonzero(n):
        a, b = first[i], first[i + 1]
        out[i, 9] = len(np.unique(h[a:b])) / (b - a)
        out[i, 10] = len(np.unique(three[a : b - 2])) / (b - a - 2) if b - a > 2 else 1
    lines = classes[:, 6] + 1
    out[:, 11] = np.log1p(n / lines)
    words = np.bincount(np.repeat(np.arange(rows), n) * WORD_CELLS + (h & np.uint64(WORD_CELLS - 1)).astype(np.int64), minlength=rows * WORD_CELLS)
    out[:, SHAPE:] = np.sqrt(words.reshape(rows, WORD_CELLS) / np.maximum(n, 1)[:, None])
    return out


def meta_codes(lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    """Cells of language and source and the step of the length's logarithm, as one number."""
    import zlib

    x, y = (np.array([zlib.crc32(repr(v).encode()) % META_CELLS for v in values], np.int64) for values in (lang, source))
    return (x * META_CELLS + y) * 24 + np.clip(np.log2(1 + np.maximum(n_chars, 0)), 0, 23).astype(np.int64)


def meta_cells(codes: np.ndarray) -> np.ndarray:
    """Hashed language and source, and steps of the length's logarithm."""
    out = np.zeros((len(codes), 2 * META_CELLS + 24), np.float32)
    row = np.arange(len(codes))
    out[row, codes // (24 * META_CELLS)] = 1
    out[row, META_CELLS + codes // 24 % META_CELLS] = 1
    out[row, 2 * META_CELLS + codes % 24] = 1
    return out


def meta_features(lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    return meta_cells(meta_codes(lang, source, n_chars))


@dataclass
class View:
    """A standardised logistic regression with ridge, and its calibration (slope, intercept)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.intercept, -12, 12)


def _slopes(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The Hessian and, as its last row, the gradient of the weighted log loss. x ends in a column of ones."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.vstack([(x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x, x.T @ (weight * (p - y))])


def _step(sums: np.ndarray, w: np.ndarray, pull: float) -> np.ndarray:
    ridge = np.full(len(w), pull)
    ridge[-1] = 1e-3
    return np.linalg.solve(sums[:-1] + np.diag(ridge), sums[-1] + ridge * w)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float, steps: int = 12) -> np.ndarray:
    x = _ones(x)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        step = _step(_slopes(x, y, weight, w), w, pull)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    """Both views and the log odds of the labelled rows' classes; None where nothing could be learned."""

    text: View
    meta: View
    prior: float

    def log_odds(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return a + b - self.prior, a, b


SIZES = {"text": SHAPE + WORD_CELLS, "meta": 2 * META_CELLS + 24}
OTHER = {"text": "meta", "meta": "text"}


def _given(judges: list[View], x: np.ndarray) -> np.ndarray:
    """The label that the first sure view of all rounds hands on; -1: none is sure."""
    out = np.full(len(x), -1)
    for view in judges:
        p = 1 / (1 + np.exp(-view.raw(x)))
        out = np.where((out < 0) & (p >= SURE), 1, np.where((out < 0) & (1 - p >= SURE), 0, out))
    return out


def _moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each class, the weight of its rows and their weighted sums and sums of squares."""
    return np.vstack([np.concatenate([[weight[y == c].sum()], weight[y == c] @ x[y == c], weight[y == c] @ x[y == c] ** 2]) for c in (0, 1)])


def _pool_sums(pool: DataFrame | None, judges: dict[str, list[View]], now: dict[str, tuple[View, np.ndarray] | None]) -> dict[str, np.ndarray]:
    """Sums over all rows of the pool that have a pseudo-label: for each of the views in `now` the moments, or the slopes at a view with the weights of the classes."""
    shapes = {n: (2, 1 + 2 * SIZES[n]) if at is None else (SIZES[n] + 2, SIZES[n] + 1) for n, at in now.items()}
    out = {n: np.zeros(s) for n, s in shapes.items()}
    if pool is None or not judges["text"]:
        return out
    shared = pool.sparkSession.sparkContext.broadcast((judges, now))

    def add(total: dict[str, np.ndarray], blobs: list[bytes]) -> None:
        for blob in blobs:
            at = 0
            values = np.frombuffer(blob)
            for n, s in shapes.items():
                total[n] += values[at : at + s[0] * s[1]].reshape(s)
                at += s[0] * s[1]

    def one_row(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        from pyspark import TaskContext

        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MEETINGS], pa.int32()), pa.array([b"".join(x.tobytes() for x in total.values())])], names=["part", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges, now = shared.value
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            total = total or {n: np.zeros(s) for n, s in shapes.items()}
            codes = batch.column(1).to_numpy()
            x = {"text": np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(len(codes), -1), "meta": meta_cells(codes)}
            for n, at in now.items():
                y = _given(judges[OTHER[n]], x[OTHER[n]])
                some = np.flatnonzero(y >= 0)
                times = np.ones(len(some))
                if n == "meta":  # many rows are alike
                    _, first, times = np.unique(codes[some] * 2 + y[some], return_index=True, return_counts=True)
                    some = some[first]
                rows, y, times = x[n][some].astype(np.float64), y[some], times.astype(np.float64)
                if at is None:
                    total[n] += _moments(rows, y, times)
                elif len(some):
                    view, weights = at
                    total[n] += _slopes(_ones((rows - view.mean) / view.scale), y, times * weights[y], view.weights)
        if total:
            yield one_row(total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None  # a partition without rows sends nothing: a row of zeros is as large as one of sums
        for batch in batches:
            if batch.num_rows:
                total = total or {n: np.zeros(s) for n, s in shapes.items()}
                add(total, batch.column(1).to_pylist())
        if total:
            yield one_row(total)

    # A few tasks for each core: they stream, and each has a row of sums and its bookkeeping.
    few = pool.select("text", "meta").coalesce(4 * pool.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "part int, sums binary")
    add(out, [bytes(r.sums) for r in parts.repartition(MEETINGS, "part").mapInArrow(meet, "part int, sums binary").collect()])
    shared.destroy()
    return out


def _own(x: np.ndarray, y: np.ndarray, view: View | None) -> np.ndarray:
    """The same sums over labelled rows, a thousand at a time, so that the driver stays small."""
    total = 0.0
    for i in range(0, len(y), 1000):
        rows, t = x[i : i + 1000].astype(np.float64), y[i : i + 1000]
        total = total + (_moments(rows, t, np.ones(len(t))) if view is None else _slopes(_ones((rows - view.mean) / view.scale), t, np.ones(len(t)), view.weights))
    return total


def _fit_views(data: dict[str, np.ndarray], y: np.ndarray, pool: DataFrame | None, judges: dict[str, list[View]], steps: int = 12) -> dict[str, View]:
    """Both views, fitted to labelled rows and to all rows of the pool that have a pseudo-label."""
    views, weights = {}, {}
    for n, found in _pool_sums(pool, judges, {"text": None, "meta": None}).items():
        weights[n] = PSEUDO_WEIGHT * np.minimum(1, HANDED * len(judges[n]) / np.maximum(found[:, 0], 1))
        sums = _own(data[n], y, None).sum(0) + weights[n] @ found
        mean, square = sums[1 : SIZES[n] + 1] / sums[0], sums[SIZES[n] + 1 :] / sums[0]
        views[n] = View(mean, np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-3), np.zeros(SIZES[n] + 1))
        if judges[n]:  # the last round's fit is near
            last, v = judges[n][-1], views[n]
            v.weights = np.append(last.weights[:-1] * v.scale / last.scale, last.weights[-1] + last.weights[:-1] @ ((v.mean - last.mean) / last.scale))
    left = ["text", "meta"]
    for _ in range(steps):
        found = _pool_sums(pool, judges, {n: (views[n], weights[n]) for n in left})
        for n in list(left):
            v = views[n]
            step = _step(found[n] + _own(data[n], y, v), v.weights, 10.0)
            v.weights = v.weights - step
            if np.abs(step).max() < 1e-6:
                left.remove(n)
        if not left:
            break
    for v in views.values():  # the order of sums varies from run to run
        v.weights = np.round(v.weights, 7)
    return views


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: DataFrame | None, rounds: int = ROUNDS) -> CoTrained | None:
    """Learns from four fifths of the labelled rows and the pool (text, meta), and calibrates on the rest of the labelled rows."""
    check = np.arange(len(y)) % 5 == 4
    fit = ~check
    if min((y[fit] == 0).sum(), (y[fit] == 1).sum()) == 0:
        return None
    data = {"text": text, "meta": meta}
    own = {n: x[fit] for n, x in data.items()}
    judges: dict[str, list[View]] = {"text": [], "meta": []}
    views = _fit_views(own, y[fit], pool, judges)
    for _ in range(rounds if pool is not None else 0):
        for n, v in views.items():
            judges[n].append(v)
        views = _fit_views(own, y[fit], pool, judges)
    for name, v in views.items():
        if len(set(y[check].tolist())) == 2:
            w = _newton(v.raw(data[name][check])[:, None], y[check], np.ones(check.sum()), 1.0)
            v.slope, v.intercept = max(float(w[0]), 0.0), float(w[1])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return CoTrained(views["text"], views["meta"], float(np.log(rate / (1 - rate))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(0)):
            s = batch.slice(a, b - a)
            text = text_features(s.column(0))
            meta = meta_codes(s.column(1).to_pylist(), s.column(2).to_pylist(), s.column(3).fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in text], pa.binary()), pa.array(meta), *s.columns[4:]], names=["text", "meta", "key"])


VIEW = ("text", "lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality") -> CoTrained | None:
    """Learns from the given labelled rows and all other rows of `docs` (id, text, lang, source, n_chars)."""
    docs, labels = exact(docs, id_column, *VIEW), exact(labels, id_column, label)
    order = F.xxhash64(id_column)
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_column).agg(F.max(label).cast("int").alias("quality")).orderBy(order, id_column).limit(FIT_ROWS)
    chosen = staged(known, "quality-rows")
    view = ("text", "lang", "source", F.col("n_chars").cast("long"))
    rows = docs.select(id_column, *VIEW).join(F.broadcast(chosen), id_column).select(*view, "quality")
    got = rows.mapInArrow(_features, "text binary, meta long, key int").collect()
    if not got:
        return None
    # The order of rows varies from run to run; that of their features doesn't.
    got.sort(key=lambda r: (r[2], bytes(r[0]), r[1]))
    text = np.frombuffer(b"".join(bytes(r[0]) for r in got), np.float32).reshape(len(got), -1)
    meta = meta_cells(np.array([r[1] for r in got]))
    y = np.array([r[2] for r in got], float)
    # 0 and 1 alternate before the split into fit and calibration rows
    shuffle = np.random.default_rng(7).permutation(len(y))
    text, meta, y = text[shuffle], meta[shuffle], y[shuffle]
    if len(set(y.tolist())) < 2:
        return None
    return co_train(text, meta, y, _pool(docs, labels, id_column))


def _pool(docs: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """The features of all documents without a label, those without an id among them."""
    rows = docs.select("text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.col(id_column).alias("key"))
    kind = rows.schema["key"].dataType.simpleString()

    def made(some: DataFrame) -> DataFrame:
        return some.mapInArrow(_features, f"text binary, meta long, key {kind}")

    labelled = labels.select(F.col(id_column).alias("key")).where("key IS NOT NULL").distinct()
    others = made(rows.where("key IS NOT NULL")).join(labelled, "key", "left_anti")
    return staged(others.unionByName(made(rows.where("key IS NULL"))).select("text", "meta"), "quality-pool")


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """Adds quality_score, quality_text and quality_meta (0 to 1) to `docs` (text, lang, source, n_chars and any others)."""
    names = ("quality_score", "quality_text", "quality_meta")
    stay = [i for i, c in enumerate(docs.columns) if c not in names]
    given = docs.toDF(*(f"own{i}" for i in range(len(docs.columns)))).select(*(f"own{i}" for i in stay)).toDF(*(docs.columns[i] for i in stay))
    if model is None:
        return given.withColumns({n: F.lit(1.0) for n in names})
    plain = given.toDF(*(c if c in VIEW else f"_{i}" for i, c in enumerate(given.columns)))  # Arrow maps take no dots in names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given_names = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in VIEW}
            texts = batch.column(at["text"])
            for a, b in text_slices(texts):
                s = batch.slice(a, b - a)
                n_chars = s.column(at["n_chars"]).cast(pa.int64()).fill_null(0).to_numpy()
                odds = m.log_odds(text_features(s.column(at["text"])), meta_features(s.column(at["lang"]).to_pylist(), s.column(at["source"]).to_pylist(), n_chars))
                yield pa.RecordBatch.from_arrays([*s.columns, *(pa.array(1 / (1 + np.exp(-o.astype(np.float64)))) for o in odds)], names=[*given_names, *names])

    schema = T.StructType([*given.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return plain.mapInArrow(run, schema)


def kept_only(docs: DataFrame, model: CoTrained | None, at_least: float = THRESHOLD) -> DataFrame:
    """The documents that score `at_least` so much, with their own columns, whatever the names of those."""
    plain = docs.toDF(*(c if c in VIEW else f"own{i}" for i, c in enumerate(docs.columns)))
    return score(plain, model).where(F.col("quality_score") >= at_least).select(*plain.columns).toDF(*docs.columns)
