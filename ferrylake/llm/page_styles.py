"""Which elements of a page its styles show: the cascade of `display` and `visibility`.

Read are rules of style sheets that hold on any screen, inline styles, and the `hidden` attribute. Selectors are compounds of
an element name or `*`, ids, classes and attributes, joined by descendant and child combinators. Rules with any other
selector (states, siblings, pseudo-elements) and rules nested in other style rules are left out. The winner of each property
is the declaration with `!important`, then the inline one, then the more specific, then the later; layers count as if they
were none. `display` of anything but `none` overrides the `hidden` attribute; `visibility` is inherited, and a child may be
visible in a hidden parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: Comments, strings and addresses of a style sheet; its parts and their marks; queries of media that a screen meets always.
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_OPAQUE = re.compile(r"/\*.*?(?:\*/|\Z)|\[\s*[\w-]+\s*[~|^$*]?=\s*(?:\"[^\"\n]*+\"|'[^'\n]*+')\s*\]|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|url\([^)\"']*+\)?", re.S | re.I)
_PART = re.compile(r"([^{};]*+)([{};]|\Z)")
_AT = re.compile(r"@([\w-]*)\s*(.*)", re.S)
_SCREEN = re.compile(r"(?:(?:only\s+)?(?:all|screen)|not\s+(?:print|speech))?")
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*", re.I)
_OF_INTEREST = re.compile(r"\b(?:display|visibility)\s*:", re.I)
_COMPOUND = re.compile(r"(?:\*|[a-z][\w-]*)?(?:[#.][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:[\w-]+|\"[^\"]*\"|'[^']*')\s*)?\])*", re.I)
_SIMPLE = re.compile(r"([#.])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
_COMBINATOR = re.compile(r"\s*(>)\s*|\s+")

# Keywords of the two properties, by what they say of an element in a parent that is shown.
DISPLAYS = frozenset("block inline inline-block flow flow-root flex inline-flex grid inline-grid table inline-table table-row table-cell table-caption table-column table-column-group table-header-group table-footer-group table-row-group list-item contents ruby run-in initial inherit unset".split())
VISIBLE = {"visible": True, "initial": True, "hidden": False, "collapse": False}
INHERITED = frozenset({"inherit", "unset", "revert", "revert-layer"})


class Compound(NamedTuple):
    """What one element has to be; `child`: it is the parent of the next compound's element, not any ancestor."""

    tag: str
    ids: frozenset[str]
    classes: frozenset[str]
    attributes: tuple[tuple[str, str | None], ...]
    child: bool


class Rule(NamedTuple):
    parts: tuple[Compound, ...]
    specificity: tuple[int, int, int]
    declarations: tuple[tuple[str, str, bool], ...]


def on_screen(media: str) -> bool:
    return any(_SCREEN.fullmatch(q.strip().lower()) for q in media.split(","))


def _applies(rule: str) -> bool:
    """Whether the rules in an at-rule hold on any screen; those that depend on its size, say, don't."""
    name, rest = _AT.match(rule).groups()
    name = name.lower()
    return name == "layer" or (name == "media" and on_screen(rest)) or (name == "supports" and not rest.lower().startswith("not"))


def declarations(text: str) -> tuple[tuple[str, str, bool], ...]:
    """(property, keyword, important) of a block or an inline style; unknown keywords are left out, as browsers do."""
    out = []
    for one in text.split(";"):
        if found := _DECLARATION.fullmatch(one):
            name, value, important = found[1].lower(), found[2].lower(), bool(found[3])
            if value in INHERITED or (value in VISIBLE if name == "visibility" else value == "none" or value.split()[0] in DISPLAYS):
                out.append((name, value, important))
    return tuple(out)


def selector(text: str) -> tuple[Compound, ...] | None:
    """The compounds of a selector, or None where it holds something that is not read here."""
    parts, at = [], 0
    while True:
        found = _COMPOUND.match(text, at)
        if not found[0]:
            return None
        end = found.end()
        between = _COMBINATOR.match(text, end) if end < len(text) else None
        if end < len(text) and not between:
            return None
        ids, classes, attributes = set(), set(), []
        tag = re.match(r"[*\w-]*", found[0])[0].lower()
        for one in _SIMPLE.finditer(found[0]):
            kind, name, attribute, *values = one.groups()
            if attribute:
                attributes.append((attribute.lower(), next((v for v in values if v is not None), None)))
            else:
                (ids if kind == "#" else classes).add(name.lower())
        parts.append(Compound("" if tag == "*" else tag, frozenset(ids), frozenset(classes), tuple(attributes), bool(between and between[1])))
        if not between:
            return tuple(parts)
        at = between.end()


def _specificity(parts: tuple[Compound, ...]) -> tuple[int, int, int]:
    return sum(len(p.ids) for p in parts), sum(len(p.classes) + len(p.attributes) for p in parts), sum(bool(p.tag) for p in parts)


def rules(sheet: str, media: str = "") -> list[Rule]:
    """Rules of a style sheet that say something of the two properties and hold on any screen."""
    out: list[Rule] = []
    if not _OF_INTEREST.search(sheet) or not on_screen(media):
        return out
    # Each open block: it holds on the screen; its selectors (None outside of style rules); its declarations so far.
    blocks: list[tuple[bool, list[str] | None, list[str]]] = [(True, None, [])]
    cleaned = _OPAQUE.sub(_cleaned, sheet).replace("<!--", " ").replace("-->", " ")
    for part, mark in _PART.findall(cleaned):
        holds, names, said = blocks[-1]
        part = part.strip()
        if mark == "{":
            if part.startswith("@"):
                blocks.append((holds and _applies(part), names, said if holds and _applies(part) else []))
            else:
                blocks.append((holds, part.split(",") if names is None else [], []))
            continue
        if holds and names and part:
            said.append(part)
        if mark == "}" and len(blocks) > 1:
            blocks.pop()
            if said and blocks[-1][2] is not said:
                out += _made(names, said)
    for _, names, said in blocks[1:]:  # the sheet ends within a rule
        if said and names:
            out += _made(names, said)
    return out


def _cleaned(found: re.Match) -> str:
    """Nothing of comments and strings; attribute selectors stay, but for those that hold marks of the sheet's own, which no rule then has."""
    if found[0][0] != "[":
        return " "
    return "[?]" if any(c in found[0] for c in "{};,") else found[0]


def _made(names: list[str], said: list[str]) -> Iterator[Rule]:
    found = declarations(";".join(said))
    if found:
        for name in names:
            if parts := selector(name.strip()):
                yield Rule(parts, _specificity(parts), found)


def _is(node, compound: Compound) -> bool:
    a = node.attrs
    return (
        (not compound.tag or compound.tag == node.tag)
        and (not compound.ids or compound.ids == {a.get("id", "").lower()})
        and (not compound.classes or compound.classes <= set(a.get("class", "").lower().split()))
        and all(k in a and (v is None or a[k] == v) for k, v in compound.attributes)
    )


def _matches(rule: Rule, path: list) -> bool:
    """Whether the rule's selector holds for the last element of a path from the root. Linear in path and selector."""
    if not _is(path[-1], rule.parts[-1]):
        return False
    ends = [len(path) - 1]  # where the compounds read so far may begin
    for compound in rule.parts[-2::-1]:
        places = [d - 1 for d in ends if d] if compound.child else range(max(ends))
        ends = [d for d in places if _is(path[d], compound)]
        if not ends:
            return False
    return True


def _key(rule: Rule) -> str:
    """What an element must have for the rule's last compound: its rarest part."""
    last = rule.parts[-1]
    return next((f"#{x}" for x in last.ids), None) or next((f".{x}" for x in last.classes), None) or last.tag


def resolve(root, sheet: list[Rule]) -> None:
    """Sets `display` and `visible` of each element of a tree. What is not displayed is not looked into."""
    by: dict[str, list[tuple[int, Rule]]] = {}
    for i, rule in enumerate(sheet):
        by.setdefault(_key(rule), []).append((i, rule))
    path: list = []
    work = [(root, 0, True)]
    while work:
        node, depth, visible = work.pop()
        del path[depth:]
        path.append(node)
        a = node.attrs
        best: dict[str, tuple] = {}
        if by:
            keys = ["", node.tag]
            if a:
                keys += [f"#{a['id'].lower()}"] if "id" in a else []
                keys += [f".{c}" for c in set(a.get("class", "").lower().split())]
            for key in keys:
                for i, rule in by.get(key, ()):
                    if _matches(rule, path):
                        _take(best, rule.declarations, False, rule.specificity, i)
        if "style" in a and _OF_INTEREST.search(a["style"]):
            _take(best, declarations(_COMMENT.sub(" ", a["style"])), True, (0, 0, 0), len(sheet))
        default = "none" if "hidden" in a or (node.tag == "dialog" and "open" not in a) else "block"
        display = best["display"][1] if "display" in best else default
        node.display = (default if display in ("revert", "revert-layer") else display) != "none"
        node.visible = VISIBLE.get(best["visibility"][1], visible) if "visibility" in best else visible
        if node.display:
            work.extend((c, depth + 1, node.visible) for c in node.children if not isinstance(c, str))


def _take(best: dict[str, tuple], found: tuple[tuple[str, str, bool], ...], inline: bool, specificity: tuple[int, int, int], order: int) -> None:
    for at, (name, value, important) in enumerate(found):
        rank = (important, inline, specificity, order, at)
        if name not in best or best[name][0] < rank:
            best[name] = (rank, value)
