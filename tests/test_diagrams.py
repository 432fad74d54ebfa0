"""The rule compiler, two-phase conversion, and scopes."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from ferrylake.operators.convert import convert, convert_nodes, laid_out, nearest_scope
from ferrylake.operators.rules import ADDED, BUILT_IN, WHOLE, Catalogue, Edit, Rule
from ferrylake.plans import catalogue as C
from ferrylake.sources import scans


def nodes_of(spark, *texts):
    return scans.xml_nodes(spark.createDataFrame(list(enumerate(texts)), "id long, xml string"), "id", "xml")


def test_every_rule_is_in_a_golden_row():
    named = {r for k in range(len(C.CASES)) for x in C.VERSIONS for r in C.expected(k, x)} | {r for _, rules in C.BY_OPTION for r in rules}
    assert named == {r.id for r in C.CATALOGUE.rules} and len(named) > 90


def test_messages_options_and_nested_parts(spark):
    rules = [Rule("a", ("x",), "INFO", "{{ part.who }} at {{ attr.k }}", "v"), Rule("b", (), "TASK", "{{kind}} of {{ name }}", options=(("kind", "new"),)), Rule("c", (), "INFO", "gone", since=9)]
    book = Catalogue(rules, {"who": "{{ part.deep }}!", "deep": "{{ element }} {{ value }}"}, {"kind": "old"})
    nodes = nodes_of(spark, '<x v="1$" k="2"/>', "<y>", None)
    assert [(r.rule, r.message) for r in book.check(nodes, 1).collect()] == [("a", "x 1$! at 2")]
    assert sorted((r.rule, r.message) for r in book.check(nodes, F.lit(9), {"kind": "new"}).collect()) == [("a", "x 1$! at 2"), ("b", "new of x"), ("c", "gone")]
    for wrong in (lambda: book.check(nodes, 1, {"other": 1}), lambda: Catalogue([rules[0], rules[0]]), lambda: Catalogue([], {"p": "{{ part.p }}"}).text("{{ part.p }}")):
        with pytest.raises(ValueError):
            wrong()


def converted(spark, xml, rules):
    docs = spark.createDataFrame([(1, xml)], "id long, xml string")
    return convert(docs, "id", "xml", Catalogue(rules).script(scans.xml_nodes(docs, "id", "xml"), 0)).first()


def test_later_priorities_win_and_phases_are_in_order(spark):
    def write(id, value, priority):
        return Rule(id, ("t",), "INFO", "", priority=priority, edits=(Edit("set", "a", lambda n: F.lit(value)),))

    three = [write("r4", "added", ADDED), write("r2", "whole", WHOLE), write("r3", "built in", BUILT_IN)]
    assert converted(spark, "<p><t/></p>", three).xml == '<p>\n  <t a="added" />\n</p>'
    assert converted(spark, "<p><t/></p>", three[1:]).xml == '<p>\n  <t a="built in" />\n</p>'
    # The element that one rule drops is gone before another sets its attribute; a stripped attribute can be set anew.
    drop = Rule("d", ("u",), "INFO", "", priority=ADDED, edits=(Edit("drop"),))
    inside = Rule("i", ("w",), "INFO", "", priority=WHOLE, edits=(Edit("text", value=lambda n: F.lit("never")),))
    again = Rule("s", ("t",), "INFO", "", edits=(Edit("set", "a", lambda n: n.a("a")), Edit("strip", "a")))
    got = converted(spark, '<p><t a="1" b="2"/><u><w/></u></p>', [drop, inside, again])
    assert (got.xml, got.applied) == ('<p>\n  <t b="2" a="1" />\n</p>', 3)


def test_broken_empty_and_prefixed_documents(spark):
    docs = spark.createDataFrame([(1, "<a>"), (2, None), (3, '<q:a xmlns:q="urn:x"><q:b/></q:a>'), (4, "<a><b/></a>"), (4, "<c/>")], "id long, xml string")
    rules = Catalogue([Rule("r", ("b",), "INFO", "", edits=(Edit("set", "k", lambda n: F.lit("é")),)), Rule("s", ("a",), "INFO", "", edits=(Edit("drop"),))])
    got = sorted((r.doc_id, r.xml or "", r.error is None) for r in convert(docs, "id", "xml", rules.script(scans.xml_nodes(docs, "id", "xml"), 0)).collect())
    assert got == [("1", "", False), ("2", "", False), ("3", '<q:a xmlns:q="urn:x">\n  <q:b k="é" />\n</q:a>', True), ("4", '<a>\n  <b k="é" />\n</a>', True), ("4", "<c />", True)]


def test_one_document_of_100_000_nodes(spark):
    xml = "<p>" + '<s><t a="1"/></s>' * 50_000 + "</p>"
    got = converted(spark, xml, [Rule("r", ("t",), "INFO", "", "a", edits=(Edit("strip", "a"), Edit("set", "b", lambda n: n.value, owner=True)))])
    assert got.applied == 100_000 and got.xml.count('<s b="1">') == 50_000 and "a=" not in got.xml


def test_scopes_by_intervals(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(20):
        work, text = ["<p>"], ""
        for _ in range(60):
            if rng.random() < 0.5 or len(work) < 2:
                text += (tag := rng.choice(("<g>", "<s>")))
                work.append(tag)
            else:
                text += work.pop().replace("<", "</")
        texts.append("<p>" + text + "".join(x.replace("<", "</") for x in reversed(work)))
    nodes = nodes_of(spark, *texts)
    rows = [r.asDict() for r in nodes.collect()]
    by = {(r["doc_id"], r["node"]): r for r in rows}
    want = {}
    for r in rows:
        at = r
        while at and at["tag"] != "g":
            at = by.get((r["doc_id"], at["parent"]))
        want[r["doc_id"], r["node"]] = at["node"] if at else None
    found = nearest_scope(nodes, nodes.where("tag = 'g'")).collect()
    assert len(found) == len(rows) and {(r.doc_id, r.node): r.scope for r in found} == want


def test_a_node_is_looked_at_once_for_all_versions(spark):
    """`check_at` finds what `check` finds at each version."""
    texts = [f'<process id="p" {C.PROCESS[0]}>{x}</process>' for x, _ in C.CASES]
    nodes, versions = nodes_of(spark, *texts, "<broken"), {x: C.v(x) for x in C.VERSIONS}
    for options in (None, {"keep_blank": True}):
        want = sorted((r.doc_id, r.node, x, r.rule) for x, n in versions.items() for r in C.CATALOGUE.check(nodes, n, options).select("doc_id", "node", "rule").collect())
        found = C.CATALOGUE.check_at(nodes, versions, options).select("doc_id", "node", "version", "rule").collect()
        assert want and sorted(map(tuple, found)) == want
    some = C.CATALOGUE.check_at(nodes, versions, None, ["priority-old"]).collect()
    assert some and {r.rule for r in some} == {"priority-old"}


def test_documents_meet_their_edits_without_a_shuffle(spark):
    """What `convert` gives, with documents over several Arrow batches, null and broken ones, and prefixes."""
    texts = [f'<process id="p" {C.PROCESS[0]}>{x}</process>' for x, _ in C.CASES] + ["<a>", None, "", '<q:a xmlns:q="urn:x"> <q:b/></q:a>', '<a xml:lang="x" t="&lt;&#10;"> b&amp; <c/> d </a>', "<a/>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, xml string").coalesce(1)
    want = sorted(map(tuple, convert(docs, "id", "xml", C.CATALOGUE.script(scans.xml_nodes(docs, "id", "xml"), C.v("8.10"))).collect()), key=str)
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = convert_nodes(scans.xml_nodes(docs, "id", "xml", source=True), C.CATALOGUE.edits(C.v("8.10")))
            assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == len(texts)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroup" not in plan


def test_xml_is_laid_out_as_the_library_does():
    rng, some = random.Random(1), ["", " ", "\n  ", "a<b", "x & y", "é", ' say "hi" ', "\r\n\t"]

    def tree(depth):
        e = ET.Element(rng.choice("abé"), {rng.choice("klm"): rng.choice(some) for _ in range(rng.randrange(3))})
        e.text, e.tail = rng.choice([None, *some]), rng.choice([None, *some]) if depth else None
        e.extend(tree(depth + 1) for _ in range(rng.randrange(4) if depth < 4 else 0))
        return e

    for _ in range(300):
        x = tree(0)
        got = laid_out(x)
        ET.indent(x, "  ")
        assert got == ET.tostring(x, "unicode")
    assert laid_out(ET.fromstring('<a xml:lang="x"/>')) is None
