"""Two-phase conversion of XML documents by an edit script, and lookups of enclosing scopes."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree.ElementTree import Element

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONVERTED = "doc_id string, xml string, applied int, error string"
#: Documents that meet their edits in one group, about.
BUCKET_DOCUMENTS = 200


def convert(docs: DataFrame, id_column: str, column: str, script: DataFrame) -> DataFrame:
    """doc_id, the new XML (UTF-8, indented by two), how many edits were applied, and the error of a document that can't be read.

    First elements go, with all below them, then attributes, then come the conversions; edits of what is gone are not
    applied. Within a phase edits are in the order of their priority, node and ordinal, so of two that set one attribute
    the later priority wins. Documents meet their edits in a cogrouped map over buckets of documents.
    Documents without edits are only laid out anew. Several documents under one id all get its edits.
    """

    def run(key: tuple, texts: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        edits = edits.sort_values(["phase", "priority", "of", "ordinal"], kind="stable")
        by: dict[str, list] = {}
        for doc, *row in edits[["doc_id", "node", "action", "name", "value", "attrs"]].itertuples(index=False):
            by.setdefault(doc, []).append(row)
        out = [(d, *edited(t, by.get(d, []))) for d, t in zip(texts.doc_id, texts["text"], strict=True)]
        return pd.DataFrame(out, columns=["doc_id", "xml", "applied", "error"])

    texts = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(column).cast("string").alias("text"))
    buckets = max(1, -(-texts.count() // BUCKET_DOCUMENTS))
    some = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).groupBy("bucket")
    return some(texts).cogroup(some(script)).applyInPandas(run, CONVERTED)


def convert_nodes(nodes: DataFrame, edits: Column) -> DataFrame:
    """What `convert` gives, from the nodes of `xml_nodes` with their `source` and the array of edits of each node.

    The nodes of a document stand one after another from its first on, and nothing between their scan and this one moves
    them, so each document meets its own edits as they stream through: nothing is shuffled, sorted or held but one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: str | None = None
        text: str | None = None
        held: list | None = None

        def done() -> tuple:
            held.sort(key=lambda e: e[0])  # stable: nodes and ordinals are in order
            return doc, *edited(text, [e[1:] for e in held])

        def batch(out: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "xml", "applied", "error"])

        for b in batches:
            found = b.column(3).flatten()
            attrs = found.field("attrs")
            names, values, at = attrs.keys.to_pylist(), attrs.items.to_pylist(), attrs.offsets.to_pylist()
            pairs = [list(zip(names[i:j], values[i:j], strict=True)) if j > i else () for i, j in zip(at, at[1:], strict=False)]
            order = zip(found.field("phase").to_pylist(), found.field("priority").to_pylist(), strict=True)
            rows = list(zip(order, *(found.field(k).to_pylist() for k in ("node", "action", "name", "value")), pairs, strict=True))
            at, out = 0, []
            sizes = pc.fill_null(pc.list_value_length(b.column(3)), 0).to_pylist()
            for d, n, t, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), sizes, strict=True):
                if not n:  # a document's first node, or its error
                    if held is not None:
                        out.append(done())
                    doc, text, held = d, t, []
                held += rows[at : at + size]
                at += size
            if out:
                yield batch(out)
        if held is not None:
            yield batch([done()])

    return nodes.select("doc_id", "node", "source", F.when(F.col("error").isNull(), edits).alias("edits")).mapInArrow(run, CONVERTED)


def edited(text: str | None, rows: list) -> tuple[str | None, int, str | None]:
    """One document with its edits in order: XML, how many were applied, error."""
    import io
    import xml.etree.ElementTree as ET

    try:
        if "xmlns" in (text or ""):  # no other document declares a prefix
            names = [v for _, v in ET.iterparse(io.BytesIO(text.encode()), ["start-ns"])]
            for prefix, uri in names:
                ET.register_namespace(prefix, uri)
        root = ET.fromstring(text or "")
    except ET.ParseError as e:
        return None, 0, f"not well-formed: {e}"
    except ValueError:  # a prefix that is kept for generated ones
        root = ET.fromstring(text or "")
    nodes = list(root.iter())
    above = {c: p for p in nodes for c in p} if any(r[1] == "drop" for r in rows) else {}
    gone: set = set()
    applied = 0
    for node, action, name, value, attrs in rows:
        x = nodes[int(node)] if 0 <= int(node) < len(nodes) else None
        if x is None or x in gone:
            continue
        applied += 1
        if action == "drop":
            if x is root:
                applied -= 1
                continue
            above[x].remove(x)
            gone.update(x.iter())
        elif action == "strip":
            for k in [k for k in x.attrib if k == name or k.endswith("}" + name)]:
                del x.attrib[k]
        elif action == "set":
            x.set(name, value or "")
        elif action == "text":
            x.text = value
        elif action == "append":
            c = ET.SubElement(x, name, {k: v for k, v in sorted(dict(attrs or {}).items()) if v is not None})
            c.text = value
    plain = laid_out(root)
    if plain is None:
        ET.indent(root, "  ")
        plain = ET.tostring(root, "unicode")
    return plain, applied, None


_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_ATTRIBUTE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


def laid_out(root: Element) -> str | None:
    """The XML of an element, indented by two, in one walk; None where it has names in a namespace, which need prefixes."""
    out: list[str] = []

    def write(x: Element, line: str) -> bool:
        tag, text = x.tag, x.text
        if tag[:1] == "{":
            return False
        out.append(f"<{tag}")
        for k, v in x.items():
            if k[:1] == "{":
                return False
            out.append(f' {k}="{v if v.isalnum() else v.translate(_ATTRIBUTE)}"')
        if len(x):
            below = line + "  "
            out.append(f">{text.translate(_TEXT)}" if text and text.strip() else f">{below}")
            last = len(x) - 1
            for i, c in enumerate(x):
                if not write(c, below):
                    return False
                tail = c.tail
                out.append(tail.translate(_TEXT) if tail and tail.strip() else line if i == last else below)
        elif not text:
            out.append(" />")
            return True
        else:
            out.append(f">{text.translate(_TEXT)}")
        out.append(f"</{tag}>")
        return True

    return "".join(out) if write(root, "\n") else None


def nearest_scope(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """doc_id, node, scope: of each node the innermost scope around it, itself included; null where there is none.

    Both sides carry pre-order intervals (node, last). Intervals are nested or apart, so one pass in order with a stack finds
    them in time linear in a document's nodes. Both sides are read in the order of (doc_id, node) by a sort within hash
    partitions: a document's rows stream through and only the open scopes are held.
    """
    both = nodes.select("doc_id", "node", F.lit(None).cast("int").alias("last"), F.lit(1).alias("kind")).unionByName(scopes.select("doc_id", "node", "last", F.lit(0).alias("kind")))
    ordered = both.repartition("doc_id").sortWithinPartitions("doc_id", "node", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, open_scopes = None, []
        for b in batches:
            out = []
            for d, node, last, kind in zip(b.doc_id, b.node, b["last"], b.kind, strict=True):
                if d != doc:
                    doc, open_scopes = d, []
                while open_scopes and open_scopes[-1][1] < node:
                    open_scopes.pop()
                if kind == 0:
                    open_scopes.append((node, last))
                else:
                    out.append((d, node, open_scopes[-1][0] if open_scopes else None))
            yield pd.DataFrame(out, columns=["doc_id", "node", "scope"]).astype({"node": "Int32", "scope": "Int32"})

    return ordered.mapInPandas(run, "doc_id string, node int, scope int")
