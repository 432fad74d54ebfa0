"""Scalar functions of the transition model, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrylake.schemas import COUNTER_BITS, DEFAULT_PREFIX, DEFAULT_TENANT, HISTORY_PARTITION


#: The white space that counts as blank (no-break spaces don't), and that or a control.
BLANK = r"[\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
SKIPPED = r"[\x00-\x20\x7F-\x9F\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"


def is_blank(x: Column) -> Column:
    """Nothing but white space."""
    return F.regexp_replace(x, BLANK, "") == ""


def key_encode(counter: Column, partition: int = HISTORY_PARTITION) -> Column:
    """Partition in the upper 12 bits, counter below. Counters are given, not drawn, so keys are the same in every run."""
    return F.shiftleft(F.lit(partition).cast("long"), COUNTER_BITS).bitwiseOR(counter.cast("long"))


def key_partition(key: Column) -> Column:
    return F.shiftright(key, COUNTER_BITS).cast("int")


def legacy_prefix(x: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """Null stays null."""
    return F.concat(F.lit(prefix), x)


def prefix_problem(x: Column) -> Column:
    """Why a prefix is not valid; null if it is. No prefix means the default one."""
    return F.when(x.isNull(), None).when(is_blank(x), "blank").when(F.length(x) > 100, "too long").when(~x.rlike(r"^[A-Za-z_][A-Za-z0-9._-]*$"), "bad characters")


def tenant_default(x: Column) -> Column:
    return F.when(x.isNull() | (F.length(x) == 0), DEFAULT_TENANT).otherwise(x)


def strip_all(x: Column, literal: str) -> Column:
    """Without any occurrence of a literal, wherever it stands."""
    return F.replace(x, F.lit(literal), F.lit(""))


def text_of(x: Column) -> Column:
    """As text; null becomes the text null."""
    return F.coalesce(x.cast("string"), F.lit("null"))


def is_json(x: Column) -> Column:
    """Exactly one JSON value; false for null. The parser stops after a value, whatever follows; within an array and within
    an object it does not, and no text that is more than one value is right in both.
    """
    fits = lambda before, after: F.try_parse_json(F.concat(F.lit(before), x, F.lit(after))).isNotNull()
    return fits("[", "]") & fits('{"x":', "}")


def full_name(first: Column, last: Column) -> Column:
    return F.concat(text_of(first), F.lit(" "), text_of(last))


def is_false(x: Column) -> Column:
    return F.coalesce(F.lower(x) == "false", F.lit(False))


def csv_guard(x: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula, after any white space and controls."""
    return F.when(x.rlike(rf"^{SKIPPED}*[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def kebab(x: Column) -> Column:
    """Lower-case words of an identifier, joined by hyphens; null reads as undefined."""
    words = F.regexp_extract_all(F.coalesce(x, F.lit("undefined")), F.lit("[A-Z]*[a-z]+|[A-Z]+"), F.lit(0))  # of letters only
    # Capitals before a capitalised word are a word of their own.
    parts = lambda w: F.array(F.regexp_extract(w, "^([A-Z]+)[A-Z][a-z]", 1), F.regexp_extract(w, "([A-Z][a-z]+)$", 1))
    words = F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[A-Z]{2,}[a-z]"), parts(w)).otherwise(F.array(w))))
    return F.array_join(F.transform(words, F.lower), "-")


def section_link(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("-"))


def short_type(x: Column) -> Column:
    """A type's name without packages, those of its arguments too."""
    return F.regexp_replace(x, r"[\w$]+\.", "")


def spans(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def strip_number(x: Column) -> Column:
    """A file or folder name as words, without its ordering number and suffix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\d+[_-]", ""), r"\.md$", ""), "[-_]", " ")


def title(content: Column, name: Column) -> Column:
    """The first heading of level 1 of a text; its file's name as words where there is none."""
    found = F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "[-_]", " "))


def intro(content: Column) -> Column:
    """The first line that is neither blank nor a heading, empty if there is none."""
    lines = F.filter(F.split(content, "\n", -1), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    return F.coalesce(F.trim(F.try_element_at(lines, F.lit(1))), F.lit(""))


def shift_heading(line: Column, by: int) -> Column:
    """A Markdown heading `by` levels deeper, six at most; other lines as they are."""
    marks = F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1))
    return F.when(marks > 0, F.concat(F.repeat(F.lit("#"), F.least(marks + by, F.lit(6))), F.regexp_replace(line, r"^#{1,6}", ""))).otherwise(line)


def anchor(heading: Column) -> Column:
    """The link target of a heading: lower case, white space becomes a hyphen, what is no word character is dropped."""
    ends = F.regexp_replace(heading, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(ends), r"[^\w\s-]", ""), r"\s+", "-")


def toc_line(line: Column) -> Column:
    """The entry of a table of contents for a heading of level 2 to 4; null for any other line."""
    level, heading = F.length(F.regexp_extract(line, r"^(#{2,4})\s", 1)), F.regexp_replace(F.regexp_extract(line, r"^#{2,4}\s+(.*)", 1), r"\s+$", "")
    return F.when(level > 0, F.concat(F.repeat(F.lit("  "), level - 2), F.lit("- ["), heading, F.lit("](#"), anchor(heading), F.lit(")")))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """`{{ name }}` replaced by each value, with or without inner spaces; values are not expanded again."""
    for name, x in values.items():
        template = F.regexp_replace(template, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), F.regexp_replace(text_of(x), r"([\\$])", r"\\$1"))
    return template


def nested(templates: dict[str, str], name: str, prefix: str = "templates.") -> str:
    """A template with the building blocks that it names (`{{ templates.x }}`) put in, at any depth. A block that is not there
    or that names itself, directly or through others, is an error.
    """
    pattern = re.compile(r"\{\{\s*" + re.escape(prefix) + r"([\w.-]+)\s*\}\}")

    def whole(key: str, above: tuple[str, ...]) -> str:
        if key in above:
            raise ValueError(f"templates name each other: {' > '.join((*above, key))}")
        if key not in templates:
            raise KeyError(f"no template {key}")
        return pattern.sub(lambda m: whole(m.group(1), (*above, key)), templates[key])

    return whole(name, ())


def cleanup_date(end: Column, months: int | None = 6) -> Column:
    """Calendar months after the end; null where clean-up is off."""
    return F.lit(None).cast("timestamp_ntz") if months is None else end + F.make_ym_interval(F.lit(0), F.lit(months))


def effective_job_type(own: Column, validation: Column) -> Column:
    """The job type that validation looks for: its own, or the general one; DISABLED switches it off."""
    return F.nullif(F.coalesce(validation, own), F.lit("DISABLED"))


def component_id(x: Column) -> Column:
    """Name of an application in the target; null: it has none there. Fixed values."""
    return F.when(x == "*", "*").when(x == "cockpit", "operate").when(x.isin("tasklist", "admin"), x)


def file_kind(name: Column, strict: bool = False) -> Column:
    """process or decision, by the file's suffix; null for any other, or an error that names the file where `strict`."""
    low = F.lower(name)
    kind = F.when(low.rlike(r"\.bpmn(20\.xml)?$"), "process").when(low.rlike(r"\.dmn(11\.xml)?$"), "decision")
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("no diagram: "), F.coalesce(name, F.lit("a file without name"))))) if strict else kind


def local_time(instant: Column, zone: Column | None = None) -> Column:
    """A UTC instant (timestamp without zone) as the clock of a zone shows it, the session's by default. Null stays null."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone() if zone is None else zone, instant.cast("timestamp_ntz"))


def unique_id(kind: Column, *of: Column) -> Column:
    """kind_ and seven base-36 digits of a hash: the same in every run."""
    return F.concat(kind, F.lit("_"), F.lpad(F.lower(F.conv(F.pmod(F.xxhash64(*of), F.lit(36**7)).cast("string"), 10, 36)), 7, "0"))


def rewrite_expression(x: Column) -> Column:
    """`${...}` as an expression of the target language where that is plain; unchanged where it is not.

    Operators inside string literals are rewritten too.
    """
    inner = F.regexp_extract(x, r"^[$#]\{(.*)\}$", 1)
    plain = F.regexp_replace(inner, r"execution\.getVariable\([\"'](\w+)[\"']\)", "$1")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "==", "="), "&&", "and"), r"\|\|", "or"), r"!(?!=)", "not ")
    return F.when(expression_severity(x) == "TASK", x).when(x.rlike(r"^[$#]\{.*\}$"), F.concat(F.lit("="), plain)).otherwise(F.concat(F.lit("="), x))


def expression_severity(x: Column) -> Column:
    """TASK where a method is called or the engine's context is used beyond its variables; REVIEW otherwise."""
    rest = F.regexp_replace(x, r"execution\.getVariable\([\"']\w+[\"']\)", "v")
    return F.when(x.isNull(), None).when(x.rlike(r"^[$#]\{.*\}$") & (rest.rlike(r"\w+\s*\(") | rest.rlike(r"\bexecution\b")), "TASK").otherwise("REVIEW")


def worker_name(x: Column) -> Column:
    """A worker's name from a class (simple name, first letter lower) or an expression (`${a.b(..)}` is aB)."""
    bean, method = F.regexp_extract(x, r"^[$#]\{(\w+)", 1), F.regexp_extract(x, r"^[$#]\{\w+\.(\w+)", 1)
    simple = F.substring_index(x, ".", -1)
    lower = F.concat(F.lower(F.left(simple, F.lit(1))), F.substr(simple, F.lit(2)))
    return F.when(x.isNull(), None).when(x.rlike(r"^[$#]\{"), F.concat(bean, F.upper(F.left(method, F.lit(1))), F.substr(method, F.lit(2)))).otherwise(lower)


def version_number(x: Column) -> Column:
    """major.minor as one number that orders 8.10 after 8.9."""
    return F.split_part(x, F.lit("."), F.lit(1)).cast("int") * 1000 + F.split_part(x, F.lit("."), F.lit(2)).cast("int")
