"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, decomposes compatibility forms, drops combining marks, and maps homoglyphs and digit substitutions to
Latin letters. Lexicon entries are word beginnings. An entry inside an exception phrase does not count.

The lexicon is given, or learned from labelled rows: `fit` takes at most `FIT_TOXIC` toxic and `FIT_CLEAN` other rows (in
order of a hash of their ids), counts in how many texts of either class each word beginning occurs, keeps those that
occur much more often in toxic ones (log-likelihood ratio), and weights them by their smoothed log odds. Only texts and
labels enter; ids choose folds and samples and are no input of a score.

Null and empty texts have no hits and score like a text without hits. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import exact, staged

FIT_TOXIC, FIT_CLEAN = 3000, 9000
MAX_ENTRIES = 2048
#: Word beginnings of these lengths are candidates.
PREFIX = (4, 12)
#: Log-likelihood ratio that a learned entry needs.
LEAST_EVIDENCE = 26.0
#: And how many times more often it must occur in toxic texts than in others.
LEAST_RATIO = 12
#: What another chosen entry leaves of a toxic text's say about further entries: copies of a text teach nothing new.
LEFT = 0.7
THRESHOLD = 0.7

#: Characters that stand for Latin letters in disguised words.
FOLDS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ꜰ": "f", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
}
_TABLE = str.maketrans(FOLDS)
#: Harmless phrases that contain words of common lexicons.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "idiot proof", "stupid simple", "pond scum")


#: Strokes that stand for a letter where one follows them directly.
_STROKE = re.compile(r"[|!¡](?=[^\W\d_])")


def fold(text: str) -> str:
    """Lower-cased Latin reading of a text, without characters that are not seen."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    if "|" in text or "!" in text or "¡" in text:
        text = _STROKE.sub("i", text)
    return text.translate(_TABLE)


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded word beginnings, harmless phrases, and the calibration of the hit density to a probability."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 8.0
    intercept: float = -2.0
    _machine: list = field(default_factory=list, compare=False, repr=False)

    def machine(self) -> ahocorasick.Automaton:
        if not self._machine:
            a = ahocorasick.Automaton()
            for p in map(fold, self.exceptions):
                a.add_word(p, (len(p), None))
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            a.make_automaton()
            self._machine.append(a)
        return self._machine[0]

    def entries(self, text: str) -> set[str]:
        """The entries that count in a text."""
        folded = fold(text)
        return {folded[a:b] for a, b, _ in self._found(folded)} if self.weights else set()

    def hits(self, text: str) -> tuple[float, int]:
        """Sum of the weights of entries that begin a word outside exception phrases, and their number."""
        if not self.weights:
            return 0.0, 0
        best: dict[int, float] = {}
        for start, _, weight in self._found(fold(text)):
            best[start] = max(best.get(start, 0.0), weight)
        return sum(best.values()), len(best)

    def _found(self, folded: str) -> list[tuple[int, int, float]]:
        found, safe = [], []
        for end, (n, weight) in self.machine().iter(folded):
            start = end - n + 1
            if start and folded[start - 1].isalnum():
                continue
            (safe if weight is None else found).append((start, end + 1, weight))
        return [x for x in found if not any(a <= x[0] and x[1] <= b for a, b, _ in safe)] if safe else found

    def density(self, text: str | None) -> tuple[float, int, int]:
        """Weight over the square root of the number of words; hits; words."""
        text = text if isinstance(text, str) else ""
        total, n = self.hits(text)
        words = len(text.split())
        return total / math.sqrt(16 + words), n, words

    def probability(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * density + self.intercept))))


def _beginnings(text: str) -> set[str]:
    low, high = PREFIX
    out: set[str] = set()
    for w in {"".join(c for c in w if c.isalpha()) if not w.isalpha() else w for w in fold(text).split()}:
        out.update(w[:k] for k in range(low, min(high, len(w)) + 1))
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of either class with each word beginning: summed here, so a partition sends each beginning once."""
    by: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, toxic in zip(b.text, b.toxic, strict=True):
            by[int(toxic)].update(_beginnings(text or ""))
    if by[0] or by[1]:
        keys = list(by[0].keys() | by[1].keys())
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pd.DataFrame({"entry": some, "toxic": [by[1][k] for k in some], "clean": [by[0][k] for k in some]})


def _choose(rows: list, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Longest beginnings that keep nearly all toxic texts of a shorter one, without those that extend a chosen one."""
    score = {r["entry"]: math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1)) for r in rows}
    texts = {r["entry"]: r["toxic"] for r in rows}
    chosen: dict[str, float] = {}
    for e in sorted(texts, key=lambda e: (len(e), e)):
        if any(e[:k] in chosen for k in range(1, len(e))):
            continue
        here = e
        while True:
            longer = [x for x in texts if len(x) == len(here) + 1 and x.startswith(here) and texts[x] >= 0.95 * texts[e]] if len(here) < PREFIX[1] else []
            if not longer:
                break
            here = max(longer, key=texts.__getitem__)
        chosen[here] = score[here]
    return chosen


def _tell_apart(texts: list[list[str]], needed: float) -> list[str]:
    """Entries with the most say first, each by what the texts that it is in have left; until none has `needed` texts' say."""
    inside: dict[str, list[int]] = {}
    for i, entries in enumerate(texts):
        for e in entries:
            inside.setdefault(e, []).append(i)
    rows = {e: np.array(i) for e, i in inside.items()}
    left = np.ones(len(texts))
    chosen: list[str] = []
    while rows and len(chosen) < MAX_ENTRIES:
        say, e = max((float(left[i].sum()), e) for e, i in rows.items())
        if say < needed:
            break
        left[rows.pop(e)] *= LEFT
        chosen.append(e)
    return chosen


def _calibrate(rows: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope (positive) and intercept of a logistic regression with a little shrinkage, by Newton's steps."""
    x = np.array([[r[0], 1.0] for r in rows])
    y = np.array([r[1] for r in rows], float)
    w = np.zeros(2)
    pull = np.array([1e-2, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns a lexicon from the given labelled rows. Rows without id, text or label take no part; no rows give no entries.

    Bounds: at most FIT_TOXIC and FIT_CLEAN labelled ids, of each the row with the smallest hash of its text, and of what they
    show at most the MAX_ENTRIES entries with the most evidence, chosen among the 8 * MAX_ENTRIES strongest.
    """
    docs, labels = exact(docs, id_column, "text"), exact(labels, id_column, label)
    rows = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_column).agg(F.max(label).alias("toxic"))
    order = F.xxhash64(id_column)
    some = rows.where("toxic = 1").orderBy(order, id_column).limit(FIT_TOXIC).union(rows.where("toxic = 0").orderBy(order, id_column).limit(FIT_CLEAN))
    sample = staged(docs.select(id_column, "text").where(F.col("text").isNotNull()).join(F.broadcast(some), id_column).groupBy(id_column).agg(F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), "text")).alias("x")).select("x.*").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, exceptions)
    t, c = F.col("toxic"), F.col("clean")
    expected = (t + c) * n_toxic / (n_toxic + n_clean)
    evidence = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0))
    counts = sample.mapInPandas(_count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counts.where((t > 0) & (t > expected) & (evidence >= LEAST_EVIDENCE) & (t * n_clean >= LEAST_RATIO * c * n_toxic)).orderBy(evidence.desc(), "entry").limit(8 * MAX_ENTRIES)
    entries = _choose(strong.collect(), n_toxic, n_clean)
    lexicon = Lexicon(entries, exceptions)

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"entries": [sorted(lexicon.entries(x)) for x in b.text]})

    texts = [r[0] for r in sample.where("toxic = 1").select("text").mapInPandas(present, "entries array<string>").collect()]
    needed = LEAST_EVIDENCE / (2 * math.log((n_toxic + n_clean) / n_toxic))
    lexicon = Lexicon({e: entries[e] for e in _tell_apart(texts, needed)}, exceptions)

    def densities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"density": [lexicon.density(x)[0] for x in b.text], "toxic": b.toxic.astype("int64")})

    seen = sample.mapInPandas(densities, "density double, toxic long").collect()
    slope, intercept = _calibrate([(r[0], r[1]) for r in seen])
    return Lexicon(lexicon.weights, exceptions, slope, intercept)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds `<out>` (0 to 1), `<out>_hits` and `<out>_words`. Rows keep their partitions; nothing is shuffled."""
    machine = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(f"{out} double, {out}_hits long, {out}_words long")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [machine.value.density(x) for x in texts]
        return pd.DataFrame({out: [machine.value.probability(d) for d, _, _ in found], f"{out}_hits": [n for _, n, _ in found], f"{out}_words": [w for _, _, w in found]})

    names = [out, f"{out}_hits", f"{out}_words"]
    stay = [i for i, c in enumerate(docs.columns) if c not in names]
    own = docs.toDF(*(f"own{i}" for i in range(len(docs.columns))))  # no name of theirs clashes then
    scored = own.select(*(f"own{i}" for i in stay), run(F.col(f"own{docs.columns.index(text)}")).alias("found"))
    return scored.select(*(f"own{i}" for i in stay), *(F.col(f"found.{n}") for n in names)).toDF(*(docs.columns[i] for i in stay), *names)


def held_out(id_column: str = "doc_id") -> F.Column:
    """True for the fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))
