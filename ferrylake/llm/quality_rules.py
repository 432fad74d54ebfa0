"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule is `100 * numerator (<= or >=) bound * denominator` over integer counts of a document, so the verdict is exact
and any SQL engine reproduces it. Null texts count as empty. Extra columns of the input pass through untouched, whatever
their names; in `quality_rules`, a column of the input that has the name of a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Very frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from at or an a "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les un du une que est pour qui dans par il elle avec sur au "
    "el en los del se las por para con no su al y"
).split()

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keeps a document when `100 * value >= at_least * per` and `100 * value <= at_most * per`."""

    name: str
    value: str
    per: str
    at_least: int | None = None
    at_most: int | None = None

    def failed(self) -> str:
        tests = []
        if self.at_least is not None:
            tests.append(f"100 * {self.value} < {self.at_least} * {self.per}")
        if self.at_most is not None:
            tests.append(f"100 * {self.value} > {self.at_most} * {self.per}")
        return "(" + " OR ".join(tests) + ")"


#: The two rules that decide base_failed: `bound * 1` reads as a plain number.
BASE = (Rule("length", "n_words", "1", at_least=5000), Rule("repeats", "n_repeat_words", "n_words", at_most=50))
#: The method's own table.
RULES = (
    Rule("word length", "word_chars", "n_words", at_least=200, at_most=1500),
    Rule("symbols", "n_symbols", "n_words", at_most=20),
    Rule("shouting", "n_shouts", "n_words", at_most=50),
    Rule("stop words", "n_stop_words", "n_words", at_least=3),
    Rule("repeated lines", "n_dup_lines", "n_lines", at_most=60),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_stop_words", "n_lines")
#: Low bits of a window's sort key that hold its position; texts with more words take the slower exact keys.
POSITION_BITS = 20


def _stops() -> str:
    return ", ".join(f"'{w}'" for s in STOP_WORDS for w in dict.fromkeys((s, s[:1].upper() + s[1:])))


def _bound(name: str, value: str, body: str) -> str:
    """`body` with `value` bound to a lambda variable: a column that a lambda names is unpacked anew for every element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _twice(keys: str, same: str) -> str:
    """Those of the sorted `keys` that equal a neighbour."""
    return _bound("s", keys, f"filter(s, (x, j) -> {same.format('s[j - 1]', 'j > 0')} OR {same.format('s[j + 1]', 'j < size(s) - 1')})")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """Adds the counts, base_failed and kept to each document; nothing is shuffled and no row is dropped.

    Empty and null texts have no words and fail the length rule. Repeated rows are judged alike.
    """
    judged = _judged(docs, rules, base, text)
    stay = [i for i, c in enumerate(docs.columns) if c.lower() not in {*COUNTS, "base_failed", "kept"}]
    added = judged.columns[len(docs.columns) :]
    return judged.select(*(f"own{i}" for i in stay), *added).toDF(*(docs.columns[i] for i in stay), *added)


def _judged(docs: DataFrame, rules: tuple[Rule, ...], base: tuple[Rule, ...], text: str) -> DataFrame:
    """The columns of `docs` as own0, own1 and so on, so that no name of theirs clashes, then the counts and verdicts.

    Windows of three words are found twice by sorting one long for each: hash bits above, position below. Where two
    different windows of a text share the hash bits, that text's windows are sorted again with their words.
    """
    own = [f"own{i}" for i in range(len(docs.columns))]
    docs, text = docs.toDF(*own), f"own{docs.columns.index(text)}"
    low = (1 << POSITION_BITS) - 1
    windows = _bound("w", "_w", "transform(sequence(0, size(w) - 3), i -> {})")
    key = "xxhash64(w[i], w[i + 1], w[i + 2])"
    exact = windows.format(f"struct({key} AS h, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i AS i)")
    slow = _twice("_e", "({1} AND x.h = {0}.h AND x.a = {0}.a AND x.b = {0}.b AND x.c = {0}.c)")
    fast = _twice("_s", f"({{1}} AND shiftright(x ^ {{0}}, {POSITION_BITS}) = 0)")
    #: Neighbours in order of hash bits whose words differ.
    pair = "w[{0}] = w[{1}] AND w[{0} + 1] = w[{1} + 1] AND w[{0} + 2] = w[{1} + 2]".format(f"cast(x & {low} AS int)", f"cast(f[j + 1] & {low} AS int)")
    clash = _bound("f", "_f", _bound("w", "_w", f"size(filter(f, (x, j) -> j < size(f) - 1 AND shiftright(x ^ f[j + 1], {POSITION_BITS}) = 0 AND NOT ({pair}))) > 0"))
    covered = _bound("p", "_p", "aggregate(transform(p, (v, j) -> if(j = 0, 3, least(3, v - p[j - 1]))), 0L, (t, v) -> t + v)")
    words = docs.select(*own, F.expr(f"coalesce(`{text}`, '')").alias("_t")).withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    counted = words.select(
        *own,
        "_w",
        F.expr("cast(size(_w) AS bigint)").alias("n_words"),
        F.expr("cast(length(array_join(_w, '')) AS bigint)").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_shouts"),
        F.expr(f"cast(size(filter(_w, x -> x IN ({_stops()}))) AS bigint)").alias("n_stop_words"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.expr(f"CASE WHEN size(_w) BETWEEN 4 AND {low} THEN sort_array({windows.format(f'({key} & {~low}L) | i')}) END").alias("_s"),
    )
    found = counted.withColumn("_f", F.expr(f"CASE WHEN _s IS NOT NULL THEN {fast} END"))
    found = found.withColumn("_e", F.expr(f"CASE WHEN size(_w) > {low} OR (size(_f) > 0 AND {clash}) THEN array_sort({exact}) END"))
    found = found.withColumn("_p", F.expr(f"CASE WHEN _e IS NOT NULL THEN sort_array(transform({slow}, x -> x.i)) WHEN size(_f) > 0 THEN sort_array(transform(_f, x -> cast(x & {low} AS int))) END"))
    out = found.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_shouts",
        "n_stop_words",
        F.expr(f"CASE WHEN size(_p) > 0 THEN {covered} ELSE 0L END").alias("n_repeat_words"),
        F.expr("cast(size(_l) AS bigint)").alias("n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) AS bigint)").alias("n_dup_lines"),
    )
    base_failed = F.expr(" OR ".join(r.failed() for r in base))
    failed = F.expr(" OR ".join(r.failed() for r in (*base, *rules)))
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~failed)


def kept_only(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """The documents that the table keeps, with their own columns.

    The verdict passes a generator of one row, which no filter is pushed through: else the optimizer would put the whole
    table into the filter, where the lists of words are made anew for every rule.
    """
    judged = _judged(docs, rules, base, text)
    rows = judged.select("*", F.explode(F.array("kept")).alias("verdict")).where("verdict")
    return rows.select(*judged.columns[: len(docs.columns)]).toDF(*docs.columns)


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The same result in DuckDB's SQL, by plain relational steps."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stops = _stops()
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
    u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    g AS (SELECT r, i, x AS a, lead(x) OVER z AS b, lead(x, 2) OVER z AS c FROM u WINDOW z AS (PARTITION BY r ORDER BY i)),
    f AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
    p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
    l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE translate(x, {spaces}, '') <> '' GROUP BY r),
    m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(translate(t, {spaces}, ''))::BIGINT AS word_chars,
            (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
            (length(t) - length(translate(t, '!', '')))::BIGINT AS n_shouts,
            len(list_filter(w.w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
            coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      ({" OR ".join(r.failed() for r in base)}) AS base_failed,
      NOT ({" OR ".join(r.failed() for r in (*base, *rules))}) AS kept
    FROM m"""
