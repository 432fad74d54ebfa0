"""A rule compiler: a catalogue of rules over XML nodes becomes one projection that yields an array of findings, or of edits.

A rule looks at one node with its context: its own tag, attributes, text and child tags, and those of its parent and of its
owner, the nearest ancestor that is no container of extensions. Options decide which rules are compiled in, and so do
versions, where all documents have one; where the version is a column, its interval is part of the condition. Templates are
cut up when they are compiled, nested ones included, so a message is one concatenation. Nothing is shuffled or joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions.scalars import expression_severity, rewrite_expression, text_of, worker_name

#: Phases of an edit: elements go first, then attributes, then conversions.
DROP, STRIP, CONVERT = 0, 1, 2
#: Priorities of rules that write to one place: those of whole processes and decisions, built-in ones, all others.
WHOLE, BUILT_IN, ADDED = 2, 3, 4
FINDING = "array<struct<rule:string,severity:string,message:string,link:string>>"
EDIT = "array<struct<node:int,phase:int,priority:int,rule:string,action:string,name:string,value:string,attrs:map<string,string>>>"


class Node:
    """What a rule's conditions, messages and edits may use."""

    def __init__(self, rule: Rule, options: dict[str, object]):
        self.rule, self.options = rule, options

    tag, text, kids, parent, owner_tag = (property(lambda self, c=c: F.col(c)) for c in ("tag", "text", "kids", "parent_tag", "owner_tag"))

    @cached_property
    def value(self) -> Column:
        return self.a(self.rule.attribute) if self.rule.attribute else self.text

    @cached_property
    def graver(self) -> Column:
        return expression_severity(self.value)

    @cached_property
    def expression(self) -> Column:
        return rewrite_expression(self.value)

    @cached_property
    def worker(self) -> Column:
        return worker_name(self.value)

    def a(self, name: str) -> Column:
        return F.col("attrs")[name]

    def owner(self, name: str) -> Column:
        return F.col("owner_attrs")[name]

    def has(self, *kids: str) -> Column:
        return F.arrays_overlap(self.kids, F.array(*map(F.lit, kids)))

    def word(self, name: str) -> Column:
        """The value of a name in a template."""
        if name.startswith("attr."):
            return self.a(name[5:])
        if name in self.options:
            return F.lit(self.options[name])
        words: dict[str, Callable[[], Column]] = {
            "attribute": lambda: F.lit(self.rule.attribute), "element": lambda: self.tag, "owner": lambda: F.coalesce(self.owner("id"), self.owner_tag), "name": lambda: F.coalesce(F.col("name"), self.a("id"), self.tag),
            "value": lambda: self.value, "expression": lambda: self.expression, "worker": lambda: self.worker, "parent": lambda: self.parent,
        }
        return words[name]()


Of = Callable[[Node], Column]


@dataclass(frozen=True)
class Edit:
    """drop (the element), strip (attribute `name`), set (attribute), text, append (a child `name` with `attrs`), to the node or its owner."""

    action: str
    name: str | None = None
    value: Of | None = None
    attrs: tuple[tuple[str, Of], ...] = ()
    owner: bool = False

    @property
    def phase(self) -> int:
        return {"drop": DROP, "strip": STRIP}.get(self.action, CONVERT)


@dataclass(frozen=True)
class Rule:
    """`tags`: any of them, or all nodes where empty. `attribute`: must be there, and is the value. Versions: since <= v < until."""

    id: str
    tags: tuple[str, ...]
    severity: str
    template: str
    attribute: str | None = None
    when: Of | None = None
    since: int | None = None
    until: int | None = None
    options: tuple[tuple[str, object], ...] = ()
    edits: tuple[Edit, ...] = ()
    priority: int = BUILT_IN
    link: str | None = None


class Catalogue:
    """Rules, parts that templates may name as `{{ part.x }}`, and options with their defaults."""

    def __init__(self, rules: Iterable[Rule], parts: dict[str, str] | None = None, options: dict[str, object] | None = None):
        self.rules, self.parts, self.options = list(rules), parts or {}, options or {}
        ids = [r.id for r in self.rules]
        if len(set(ids)) < len(ids):
            raise ValueError(f"rule ids repeat: {sorted({i for i in ids if ids.count(i) > 1})}")

    def held(self, version: Column | int | None, options: dict[str, object] | None) -> list[tuple[Rule, Node, Column]]:
        """Rules that may hold, with what they see and their condition; without a version that of no version."""
        unknown = set(options or ()) - set(self.options)
        if unknown:
            raise ValueError(f"no options {sorted(unknown)}")
        now, out = self.options | (options or {}), []
        for r in self.rules:
            if any(now[k] != v for k, v in r.options):
                continue
            parts = []
            for bound, low in ((r.since, True), (r.until, False)):
                if version is None:
                    continue
                if bound is not None and isinstance(version, int):
                    parts.append((version >= bound) == low)
                elif bound is not None:
                    parts.append(version >= bound if low else version < bound)
            if any(p is False for p in parts):
                continue
            n = Node(r, now)
            conditions = [p for p in parts if isinstance(p, Column)]
            if r.attribute:
                conditions.append(n.value.isNotNull())
            if r.when:
                conditions.append(r.when(n))
            held = F.lit(True)
            for c in conditions:
                held = held & c
            out.append((r, n, held))
        return out

    def text(self, template: str, seen: tuple[str, ...] = ()) -> str:
        """The template with its named parts put in; parts may have parts."""

        def part(m: re.Match) -> str:
            if m[1] in seen:
                raise ValueError(f"the template part {m[1]} holds itself")
            return self.text(self.parts[m[1]], (*seen, m[1]))

        return re.sub(r"\{\{\s*part\.([\w-]+)\s*\}\}", part, template)

    def message(self, rule: Rule, n: Node) -> Column:
        pieces = re.split(r"\{\{\s*([\w.]+)\s*\}\}", self.text(rule.template))
        return F.concat(*(F.lit(x) if k % 2 == 0 else text_of(n.word(x)) for k, x in enumerate(pieces)))

    @staticmethod
    def gathered(kind: str, found: list[tuple[Rule, Column]]) -> Column:
        """What holds, in order. Rules side by side with the same tags are looked at only for nodes of these."""
        groups: list[tuple[tuple[str, ...], list[Column]]] = []
        for r, c in found:
            if not groups or groups[-1][0] != r.tags:
                groups.append((r.tags, []))
            groups[-1][1].append(c)
        none = F.array().cast(kind)
        parts = []
        for tags, some in groups:
            held = F.filter(F.array(*some), lambda x: x.isNotNull())
            parts.append(F.when(F.col("tag").isin(*tags), held).otherwise(none) if tags else held)
        return F.concat(*parts) if parts else none

    def findings(self, version: Column | int, options: dict[str, object] | None = None) -> Column:
        """array<struct<rule, severity, message, link>> of a node, in the catalogue's order. A severity `graver` is that of the value's expression."""
        one = []
        for r, n, held in self.held(version, options):
            severity = n.graver if r.severity == "graver" else F.lit(r.severity)
            one.append((r, F.when(held, F.struct(F.lit(r.id).alias("rule"), severity.alias("severity"), self.message(r, n).alias("message"), F.lit(r.link).cast("string").alias("link")))))
        return self.gathered(FINDING, one)

    def edits(self, version: Column | int, options: dict[str, object] | None = None) -> Column:
        """array of edits of a node, in the catalogue's order."""
        text = lambda x: F.lit(None).cast("string") if x is None else x.cast("string")
        one = []
        for r, n, held in self.held(version, options):
            for e in r.edits:
                attrs = [y for k, x in e.attrs for y in (F.lit(k), text(x(n)))]
                fields = {
                    "node": F.col("owner") if e.owner else F.col("node"), "phase": F.lit(e.phase), "priority": F.lit(r.priority), "rule": F.lit(r.id), "action": F.lit(e.action), "name": F.lit(e.name).cast("string"),
                    "value": text(e.value(n) if e.value else None), "attrs": (F.create_map(*attrs) if attrs else F.create_map()).cast("map<string,string>"),
                }
                one.append((r, F.when(held, F.struct(*(c.alias(k) for k, c in fields.items())))))
        return self.gathered(EDIT, one)

    def check(self, nodes: DataFrame, version: Column | int, options: dict[str, object] | None = None, *keep: str) -> DataFrame:
        """One row a finding: doc_id, node, tag, position, rule, severity, message, link, and the columns to keep. Documents that can't be read have none."""
        found = nodes.where("error IS NULL").select("doc_id", "node", "tag", *keep, F.posexplode(self.findings(version, options)).alias("position", "f"))
        return found.select("doc_id", "node", "tag", *keep, "position", "f.*")

    def check_at(self, nodes: DataFrame, versions: dict[str, int], options: dict[str, object] | None = None, only: Iterable[str] | None = None) -> DataFrame:
        """doc_id, node, version, rule: what `check` finds at each of these versions, by their names; of the rules in `only`, where given.

        The versions that a rule is for are known beforehand, so each condition is looked at once a node.
        """
        one = []
        for r, _, held in self.held(None, options):
            at = [k for k, n in versions.items() if (r.since is None or n >= r.since) and (r.until is None or n < r.until)]
            if at and (only is None or r.id in only):
                one.append((r, F.when(held, F.struct(F.lit(r.id).alias("rule"), F.array(*map(F.lit, at)).alias("versions")))))
        found = nodes.where("error IS NULL").select("doc_id", "node", F.explode(self.gathered("array<struct<rule:string,versions:array<string>>>", one)).alias("f"))
        return found.select("doc_id", "node", F.explode("f.versions").alias("version"), F.col("f.rule").alias("rule"))

    def script(self, nodes: DataFrame, version: Column | int, options: dict[str, object] | None = None) -> DataFrame:
        """The edit script: one row an edit, `ordinal` is its place among those of its node."""
        # The outer form: Spark would look for empty arrays below the other one, and compute the edits of a node three times.
        found = nodes.where("error IS NULL").select("doc_id", F.posexplode_outer(self.edits(version, options)).alias("ordinal", "e"), F.col("node").alias("of"))
        return found.where("ordinal IS NOT NULL").select("doc_id", "of", "ordinal", "e.*")
