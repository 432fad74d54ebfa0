"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A record is its header fields, in order, and its block. From each response come a metadata record (status, media type,
title, out-links, the source's HTTP header fields) and a conversion record (the visible text as UTF-8), both of which refer
to the response (WARC-Refers-To, its target and date), name each other (WARC-Concurrent-To), and carry digests of their own
blocks beside the digests of the response. Record ids are made from the response's id, so a repeated run gives the same.

Digests are `sha1:` in base 32, as in WARC files. Dates are those of the responses. Null pages are responses with an empty
payload; a null url becomes an empty target, and white space and controls in a url are percent-encoded. Rows that repeat id and
url with another page have record ids of their own; rows that are alike in all three are one response, and give equal records.
Records that are damaged, or no responses, give no derivatives. `read_warc` goes on after damage with the next record or gzip
member that it finds; it holds one file at a time in memory, unpacked member by member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.llm.common import exact
from ferrylake.llm import html_text

DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
RECORD = "record_id string, record_type string, target_uri string, date string, content binary"
DERIVED = (
    "source_id string, record_id string, record_type string, refers_to string, concurrent_to string, target_uri string, date string, media_type string, "
    "source_payload_digest string, source_block_digest string, block_digest string, block_length long, n_links long, content string"
)

Fields = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: Fields, block: bytes) -> bytes:
    """The bytes of a record: version, fields, Content-Length, block, two empty lines."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> Fields:
    out: Fields = []
    for line in lines.split(b"\r\n" if b"\r\n" in lines else b"\n"):
        text = line.decode("utf-8", "replace")
        if out and text[:1] in (" ", "\t"):  # a folded line goes on
            out[-1] = (out[-1][0], out[-1][1] + " " + text.strip())
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def value(fields: Fields, name: str, default: str = "") -> str:
    return next((v for k, v in fields if k.lower() == name.lower()), default)


def parse(data: bytes, at: int = 0) -> tuple[Fields, bytes, int] | None:
    """The record that begins at a byte: its fields, its block and where it ends. None: there is none."""
    if data[at : at + 5] != b"WARC/":
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = _fields(data[data.find(b"\n", at) + 1 : end])
    size = value(fields, "Content-Length")
    if not size.isdigit() or end + 4 + int(size) > len(data):
        return None
    block = data[end + 4 : end + 4 + int(size)]
    after = end + 4 + int(size)
    while data[after : after + 2] == b"\r\n":
        after += 2
    return fields, block, after


def encoded_url(url: str | None) -> str:
    """A url that stays on its header line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def responses(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """WARC response records of fetched pages, with the source row's id as source_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, target, text in zip(b.source_id, b.target, b.page, strict=True):
                payload = text.encode() if isinstance(text, str) else b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                target, of_payload = encoded_url(target), digest(payload)
                name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {target} {of_payload}')}>"
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", of_payload), ("WARC-Block-Digest", digest(head + payload))]
                out.append((key, name, "response", target, DATE, record(fields, head + payload)))
            yield pd.DataFrame(out, columns=["source_id", "record_id", "record_type", "target_uri", "date", "content"])

    rows = exact(pages, id_column, url, page).select(F.col(id_column).cast("string").alias("source_id"), F.col(url).alias("target"), F.col(page).alias("page"))
    return rows.mapInPandas(run, f"source_id string, {RECORD}")


def _derive(key: str | None, data: bytes) -> list[tuple]:
    found = parse(data)
    if not found or value(found[0], "WARC-Type").lower() != "response":
        return []
    fields, block, _ = found
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.partition(b"\r\n")
    http = _fields(lines)
    source, target, date = (value(fields, n) for n in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    of_payload = value(fields, "WARC-Payload-Digest") or digest(payload)
    of_block = value(fields, "WARC-Block-Digest") or digest(block)
    kind = value(http, "Content-Type")
    charset = next((p.split("=", 1)[1].strip(" \"'") for p in kind.split(";")[1:] if p.strip().lower().startswith("charset=")), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    if "html" in kind.lower() or not kind:
        root, sheet = html_text.build(page)
        text, found_links, name = html_text.text_of(root, sheet), html_text.links(root), html_text.title(root)
    else:
        text, found_links, name = (page if kind.lower().startswith("text/") else ""), [], ""
    code = status.split(b" ")[1].decode("ascii", "replace") if status.count(b" ") else ""
    facts: Fields = [("fetchStatus", code), ("sourceContentType", kind), ("charsetForLinkExtraction", charset)]
    facts += [("title", name)] * bool(name) + [(f"sourceHeader-{k}", v) for k, v in http] + [("outlink", f"{t} L {e}") for e, t in found_links]
    body = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in facts)
    ids = {t: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {t}')}>" for t in ("metadata", "conversion")}
    out = []
    for t, media, content in (("metadata", "application/warc-fields", body), ("conversion", "text/plain; charset=utf-8", text)):
        data = content.encode("utf-8", "replace")
        other = ids["conversion" if t == "metadata" else "metadata"]
        own = digest(data)
        linked = [("WARC-Type", t), ("WARC-Record-ID", ids[t]), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other)]
        linked += [("WARC-Source-Payload-Digest", of_payload), ("WARC-Source-Block-Digest", of_block), ("WARC-Block-Digest", own), ("Content-Type", media)]
        whole = record(linked, data).decode()
        out.append((key, ids[t], t, source, other, target, date, media, of_payload, of_block, own, len(data), len(found_links), whole))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among `records` (content, and source_id if there is one)."""
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                some = b.iloc[at : at + 500]
                yield pd.DataFrame([r for key, data in zip(some.source_id, some.content, strict=True) if data is not None for r in _derive(key, bytes(data))], columns=names)

    key = F.col("source_id") if "source_id" in records.columns else F.lit(None).cast("string").alias("source_id")
    return records.select(key, "content").mapInPandas(run, DERIVED)


def write_warc(derived: DataFrame, path: str, compress: bool = True) -> None:
    """One WARC file for each partition. Records are UTF-8 here and end in two empty lines, which Spark's text writer puts."""
    lines = derived.select(F.expr("substring(content, 1, length(content) - 4)").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip" if compress else "none").text(path)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The content of a plain file, or of each gzip member. A damaged member gives what can be unpacked of it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at >= 0:
        member, out = zlib.decompressobj(31), []
        try:
            for i in range(at, len(data), 1 << 20):
                out.append(member.decompress(data[i : i + (1 << 20)]))
                if member.eof:
                    break
        except zlib.error:
            pass
        if out:
            yield b"".join(out)
        if member.eof:
            at = min(i + (1 << 20), len(data)) - len(member.unused_data)
            at = data.find(b"\x1f\x8b\x08", at)
        else:
            at = data.find(b"\x1f\x8b\x08", at + 1)


def _records(data: bytes) -> Iterator[tuple[Fields, bytes]]:
    """The records in some bytes; what lies between two of them is skipped."""
    at = data.find(b"WARC/")
    while at >= 0:
        if found := parse(data, at):
            yield found[0], data[at : found[2]]
            at = data.find(b"WARC/", found[2])
        else:
            at = data.find(b"\nWARC/", at + 1)
            at += at >= 0


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or in gzip members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["record_id", "record_type", "target_uri", "date", "content"]
        for b in batches:
            for data in b.content:
                out = []
                for part in _unpacked(bytes(data)):
                    for fields, whole in _records(part):
                        out.append((*(value(fields, n) for n in ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Date")), whole))
                        if len(out) == 500:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                yield pd.DataFrame(out, columns=columns)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz,txt,txt.gz}").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, RECORD)
