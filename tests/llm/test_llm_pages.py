import glob
import gzip
import re
from html.parser import HTMLParser

from ferrylake.llm import html_text, queries, warc

PAGE = """<html><head><title>T &amp; U</title><style>.gone{display:none}</style></head><body>
<h1>Head</h1><p>One<p>Two <b>bold</b><br>next<div hidden>no</div><div class=gone>no</div><script>no()</script><!-- no -->
<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>s<td>22</table>
<span style="display: none">no</span><a href="/there">link</a></body></html>"""


def test_layout():
    text = html_text.render(PAGE)
    assert text.split("\n") == ["Head", "", "One", "", "Two bold", "next", "", "- a", "- b", "  3. x", "  4. y", "", "name      | n", "long name | 1", "s         | 22", "", "link"]


def test_broken_and_empty_pages():
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("plain & simple") == "plain & simple"
    assert html_text.render("a <b>c</i> d <unclosed") == "a c d"
    assert "deep" in html_text.render("<div>" * 3000 + "deep")
    assert "deep" in html_text.render("<table><tr><td>" * 60 + "deep")


def test_head_ends_without_its_tag():
    assert html_text.render("<html><head><title>T</title><p>Hello<p>World") == "Hello\n\nWorld"
    assert html_text.render("<head><meta charset=utf-8>\n<link href=x>\n<style>p{color:red}</style>\n<script>no()</script> Hello <b>World</b>") == "Hello World"
    assert html_text.render("<head><noscript><img alt=no></noscript><template><p>no</template><title>T</title></head>Hello") == "Hello"
    assert html_text.render("<head>&nbsp;<title>T</title>x</br>y").strip("\xa0 ") == "x\ny"
    head = html_text.build("<head><title>T</title><p>Hello")[0]
    assert html_text.title(head) == "T"


def test_conversion_of_a_page_without_head_and_body_tags(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title>T</title><p>Hello<p>World")], "page_id long, url string, html string")
    made = {r.record_type: r.content for r in warc.derive(warc.responses(pages)).collect()}
    assert warc.parse(made["conversion"].encode())[1] == b"Hello\n\nWorld"


def test_stray_quotes_in_tags():
    assert html_text.render("<p>a<img alt=it's>b<p>c") == "ait'sb\n\nc"
    assert html_text.render("""<p class="a"">b<p>it's "c" """) == "b\n\nit's \"c\""
    assert html_text.render("<p class='x'y' title=a\"b>it's") == "it's"
    assert html_text.render('<p title="a > b">c<p title = \'>\'>d<img alt=" e>f">') == "c\n\nd e>f"
    assert html_text.render('<p title="x>all <b>the</b> text') == "all the text"
    assert html_text.links(html_text.build("<a class=it's href=/x/y/>z</a><a href='/w'>")[0]) == [("A@/href", "/x/y/"), ("A@/href", "/w")]


def test_style_rules_that_hold_on_the_screen_only():
    def shown(style, media=""):
        return html_text.render(f"<style{media}>{style}</style><p class=x>seen") == "seen"

    assert shown("@media print{.x{display:none}}") and shown(".x{display:none}", " media=print")
    assert shown("@media (max-width:600px){ .y{color:red} .x{display:none} }")
    assert shown(".y{display:none} @keyframes k{from{visibility:hidden}} .x{color:red}")
    assert shown("/* .x{display:none} */ .x:after{content:'} .x{display:none}'}")
    assert shown(".x{@media print{display:none}} .x{.y{display:none}}")
    assert not shown("@media print{.y{color:red}} .x{display:none}")
    assert not shown("@import url(a;b); @media print, screen{.x{display:none}}")
    assert not shown("@supports (display:grid){@media not print{p , .y{color:red;visibility:hidden}}}")
    assert not shown(".x{display:none}", " media=screen")


def test_visibility_is_inherited_and_may_come_back():
    r = html_text.render
    assert r("<div style='visibility:hidden'>no<p style='visibility:visible'>yes<b>both</b></div>after") == "yesboth\n\nafter"
    assert r("<div style='display:none'>no<p style='display:block;visibility:visible'>no</div>after") == "after"
    assert r("<ol style='visibility:hidden'><li>no<li style='visibility:visible'>b</ol>") == "2. b"
    assert r("<style>html{visibility:hidden} p{visibility:inherit} b{visibility:visible}</style><p>no<b>b</b>") == "b"
    assert r("<table style='visibility:hidden'>no<tr><td>no<td style='visibility:visible'>x</table>") == " | x"
    assert r("<div style='visibility:hidden'><img alt=no><input value=no></div>a") == "a"


def test_the_cascade_decides():
    def shown(style, body="<div class='a c' id=I><p class=x title=t>seen</p></div>"):
        return html_text.render(f"<style>{style}</style>{body}") == "seen"

    assert shown(".x{display:none} .x{display:block}") and not shown(".x{display:block} .x{display:none}")
    assert shown("p.x{display:block} .x{display:none}") and shown(".x{display:none;display:block}")
    assert not shown("#i .x{display:none} p.x{display:block}") and shown("#i .y{display:none}")
    assert not shown(".x{display:none!important} #I p.x{display:block}")
    assert not shown("p.x{display:none}") and shown("b.x{display:none}") and not shown(".a.c > p{display:none}")
    assert not shown(".a .x{display:none}") and not shown("body div>.x{display:none}") and shown("body > .x{display:none}")
    assert not shown("p[title]{display:none}") and not shown('p[title="t"]{display:none}') and shown("p[title=u]{display:none}") and shown('p[title=""]{display:none}')
    assert shown(".x:hover{display:none} .a + .x{display:none} .x::before{display:none} :is(p,b){display:none}")
    assert not shown("<!-- .x{display:none} -->") and not shown("*{visibility:collapse}") and not shown(".x{display:none")
    assert shown(".x{display:nothing} p{visibility:none}") and shown('p[title="a{b"]{display:none} .y{display:none}')
    assert shown(".x{display:block}", "<p class=x hidden>seen") and shown(".x{display:revert}", "<p class=x>seen<b hidden>no</b>") and not shown(".x{display:revert}", "<p class=x hidden>seen")
    assert shown(".x{display:none}", "<p class=x style='display:block'>seen") and not shown(".x{display:none!important}", "<p class=x style='display:block'>seen")
    assert shown("div > p > b{display:none}", "<div><i><p><b>seen") and not shown("div i > p > b{display:none}", "<div><div><i><p><b>seen")
    deep = "<div class=a>" * 2000 + "<p class=x>seen"
    assert not shown(".a .a > .a .x{display:none}", deep) and shown(".b .a > .a .x{display:none}", deep)


def test_list_numbers():
    r = html_text.render
    assert r("<ol><li>a<li value=5>b<li>c</ol>") == "1. a\n5. b\n6. c"
    assert r("<ol reversed><li>a<li hidden>no<li>b</ol>") == "2. a\n1. b"
    assert r("<ol reversed start=10><li>a<li>b<li value=3>c<li>d</ol>") == "10. a\n9. b\n3. c\n2. d"
    assert r("<ol type=a start=26><li>x<li>y</ol>") == "z. x\naa. y" and r("<ol type=I start=4><li>x<li type=i>y</ol>") == "IV. x\nv. y"
    assert r("<ol start=x><li value=''>a<li value=' -2x'>b</ol>") == "1. a\n-2. b" and r("<ol type=a start=0><li>x</ol>") == "0. x"


def test_row_spans_and_groups_of_rows():
    lines = lambda page: html_text.render(page).split("\n")
    assert lines("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>") == ["a | b | c", "  | d | e", "f | g | h"]
    assert lines("<table><tr><td>a<td colspan=2 rowspan=2>b<td>c<tr><td>d<td>e</table>") == ["a | b |  | c", "d |   |  | e"]
    assert lines("<table><tfoot><tr><td>foot<tbody><tr><td>one<thead><tr><td>head<tbody><tr><td>two<tfoot><tr><td>more</table>") == ["head", "one", "two", "more", "foot"]
    assert lines("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == ["a | b", "  | c", "d | e"]
    assert lines("<table><tr><td rowspan=99999999999>a<td rowspan=-3>b<tr><td>c</table>") == ["a | b", "c"]
    wide = html_text.render("<table><tr>" + "<td rowspan=9999>x" * 500 + "<tr><td>y" * 300 + "</table>")
    assert wide.count("x") == 500 and wide.count("y") == 300 and len(wide) < 300_000


def test_fields_show_their_text():
    assert html_text.render("<input value=a> <input type=email placeholder=b> <input type=password value=no> <input type=checkbox value=no> <input type=image alt=c> <input type=submit value=d> <input type=hidden value=no> <input>") == "a b c d"


class Naive(HTMLParser):
    """Words of a page in their order, by another parser and the plainest rules; for pages without styles, lists of numbers and tables."""

    def __init__(self):
        super().__init__()
        self.words, self.skip, self.open = [], 0, True

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "noscript", "template")
        self.open |= tag not in ("b", "a", "i", "em", "span")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "noscript", "template")
        self.open |= tag not in ("b", "a", "i", "em", "span")

    def handle_data(self, data):
        if self.skip:
            return
        words = data.split()
        if words and self.words and not self.open and not data[0].isspace():
            self.words[-1] += words.pop(0)
        self.words += words
        if data:
            self.open = data[-1].isspace()


def test_words_of_all_pages_by_another_parser(spark, small):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op9_html_text(spark, small).collect()}
    for page_id, text in got.items():
        plain = Naive()
        plain.feed(html[page_id])
        plain.close()
        assert re.sub(r"(?m)^( *)- ", r"\1", text).split() == plain.words


def test_all_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op9_html_text(spark, small).collect()}
    assert got == {r.page_id: html_text.render(r.html) for r in pages.collect()}
    odd = spark.createDataFrame([(1, None, "u", 1), (1, "<p>x", None, 2)], "page_id long, html string, url string, text int")
    assert sorted((r.page_id, r.text, r.url) for r in html_text.extract(odd).select("page_id", "text", "url").na.fill("").collect()) == [(1, "", "u"), (1, "x", "")]
    assert html_text.extract(odd.limit(0)).count() == 0


def test_derivatives_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", "<p>Grüße")], "page_id long, url string, html string")
    records = warc.responses(pages)
    source = {r.source_id: r for r in records.collect()}
    made = warc.derive(records).collect()
    assert sorted((r.source_id, r.record_type) for r in made) == [(str(i), t) for i in (1, 2, 3) for t in ("conversion", "metadata")]
    by = {(r.source_id, r.record_type): r for r in made}
    for (key, kind), r in by.items():
        other = by[key, "metadata" if kind == "conversion" else "conversion"]
        assert r.refers_to == source[key].record_id and r.concurrent_to == other.record_id and r.target_uri == source[key].target_uri
        fields, block, end = warc.parse(r.content.encode())
        assert end == len(r.content.encode()) and warc.digest(block) == r.block_digest == warc.value(fields, "WARC-Block-Digest") and len(block) == r.block_length
        assert warc.value(fields, "WARC-Refers-To") == r.refers_to
        _, payload, _ = warc.parse(bytes(source[key].content))
        assert warc.digest(payload.partition(b"\r\n\r\n")[2]) == r.source_payload_digest and warc.digest(payload) == r.source_block_digest
    assert warc.parse(by["1", "conversion"].content.encode())[1].decode() == html_text.render(PAGE)
    head = warc.parse(by["1", "metadata"].content.encode())[1].decode()
    assert "title: T & U\r\n" in head and "outlink: /there L A@/href\r\n" in head and "sourceHeader-Content-Type: text/html" in head


def test_damaged_records_give_nothing(spark):
    rows = [(bytearray(b"no record"),), (bytearray(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort"),), (bytearray(warc.record([("WARC-Type", "request")], b"x")),), (None,)]
    assert warc.derive(spark.createDataFrame(rows, "content binary")).count() == 0
    assert warc.derive(spark.createDataFrame([], "content binary")).count() == 0


def test_files_round_trip(spark, small, tmp_path):
    made = warc.derive(warc.responses(spark.read.parquet(f"{small}/pages.parquet"))).cache()
    warc.write_warc(made, f"{tmp_path}/w")
    for p in glob.glob(f"{tmp_path}/w/*.gz"):
        assert gzip.open(p).read(5) in (b"WARC/", b"")
    back = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted((r.record_id, bytes(r.content)) for r in back) == sorted((r.record_id, r.content.encode()) for r in made.collect())


def test_records_of_odd_rows_are_unique_and_readable(spark):
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>y"), (2, "http://a/\r\nX-Evil: 1\n", "<p>z"), (2, None, None), (None, "", "<p>\u00e9")]
    made = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(made) == 10 and len({r.record_id for r in made}) == 10
    for r in made:
        fields, block, end = warc.parse(r.content.encode())
        assert end == len(r.content.encode()) and not any(k == "X-Evil" for k, _ in fields)
        assert warc.digest(block) == r.block_digest == warc.value(fields, "WARC-Block-Digest")


def test_reading_goes_on_after_damage(spark, tmp_path):
    one, two, three = (warc.record([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<{i}>")], f"block {i}".encode() * 50) for i in (1, 2, 3))
    (tmp_path / "plain.warc").write_bytes(one + two.replace(b"Content-Length: 3", b"Content-Length: x") + b"garbage\r\n" + three)
    members = [gzip.compress(x) for x in (one, two, three)]
    broken = bytearray(members[1])
    broken[15:25] = b"\xff" * 10
    (tmp_path / "packed.warc.gz").write_bytes(members[0] + bytes(broken) + members[2])
    (tmp_path / "cut.warc.gz").write_bytes(members[0] + members[1] + members[2][:-30])
    found = [(r.record_id, bytes(r.content)) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()]
    assert sorted(found) == sorted([("<1>", one)] * 3 + [("<3>", three)] * 2 + [("<2>", two)])
