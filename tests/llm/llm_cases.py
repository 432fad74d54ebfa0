"""Rows that every operator on documents must take, and plain references."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component_id string, sketch string, `a.b` int"


def odd_rows():
    """Nulls, empty, blank and long texts, ties, repeated rows and ids, other scripts, broken white space."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    texts = ["", None, " \t\n\x0b", "one", "one two", "One  TWO", "Straße Ünïcode façade", "日本語 テキスト 日本語", "a b  c\n\n d", "x" * 3000, "Hello, world! It's 42.\n\n", "end <|endoftext|> of", "İstanbul   line"]
    texts += [" ".join(rng.choice(words) for _ in range(30_000)), " ".join(base), " ".join(base), " ".join(base[:-4] + ["z1", "z2"])]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k", "c", "s", 1) for i, t in enumerate(texts)]
    rows += [(3, "other words under the same id", None, None, None, None, None, None, None, None), rows[14], (None, "one two", None, "s", 7, None, None, None, None, None), (-7, "one two", "de", "s", 7, None, None, None, None, None)]
    return rows


def near_reference(rows, k, percent):
    """{(doc_id, n_shingles, component_id): times} by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, x, y = rows[j][0], sets[i], sets[j]
            if a is None or b is None or not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    alone = {i for i, s in enumerate(sets) if not s}
    return sorted(((d, len(sets[i]), d if i in alone else top(d)) for i, (d, _) in enumerate(rows)), key=repr)
