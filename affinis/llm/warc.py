"""Metadata and plain-text conversion records of WARC response records.

``responses`` makes a response record of each page; ``derive`` takes response
records, from there or elsewhere, and gives two records for each. Both refer to
the response by its id and keep its target, date and payload digest. The
metadata record also keeps the response's HTTP status and headers and lists the
page's title, language and links; the conversion record holds the visible text.

Record ids are name-based uuids of the kind and the content they stand for, so
a repeated run gives the same records.

Defined cases: null html is an empty payload; a null url leaves the target out;
a block without HTTP headers is payload as a whole; equal pages give equal
records; bytes that are not UTF-8 become replacement characters; an input column
named like an output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from affinis.llm.frames import without_clashes

#: Of records made from pages, which carry no time of their own.
DATE = "2025-01-01T00:00:00Z"
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>|<[!?][^>]*>", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
#: Tags inside a line; all others end one.
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())

RESPONSE = ("record_id", "target_uri", "date", "block", "payload_digest")
DERIVED = ("record_type", "record_id", "refers_to", "target_uri", "block_digest", "content_length", "record")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def write_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record; headers without a value are left out, line ends in values become spaces."""
    lines = ["WARC/1.1"] + [f"{name}: {' '.join(value.splitlines())}" for name, value in headers if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def split_http(block: bytes) -> tuple[list[str], bytes]:
    """(status line and headers, payload)."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return [], block
    return head.decode("latin-1").split("\r\n"), payload


def visible_text(page: str) -> str:
    """Text outside markup, entities resolved, one line per block, without empty lines."""

    def replacement(match: re.Match) -> str:
        tag = match[2]
        return "" if tag is None or tag.lstrip("/").lower() in INLINE else "\n"

    text = html.unescape(MARKUP.sub(replacement, page))
    return "\n".join(line for line in (" ".join(part.split()) for part in text.split("\n")) if line)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` (page_id, url, html) with the columns of ``RESPONSE`` in place of html."""
    rows = without_clashes(pages, ("page_id", "url", "html"), RESPONSE)
    kept = [name for name in rows.columns if name not in ("url", "html")]
    url_at, html_at = rows.columns.index("url"), rows.columns.index("html")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in RESPONSE}
            names = batch.column(rows_id).to_pylist()
            for name, url, page in zip(names, batch.column(url_at).to_pylist(), batch.column(html_at).to_pylist(), strict=True):
                payload = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                sha = digest(payload)
                for column, value in zip(out, (record_name("response", str(name), url or "", sha), url, date, head.encode() + payload, sha), strict=True):
                    out[column].append(value)
            columns = [batch.column(batch.schema.get_field_index(column)) for column in kept]
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[x], kind) for x, kind in zip(out, kinds, strict=True))], names=[*kept, *RESPONSE])

    rows_id = rows.columns.index("page_id")
    fields = [rows.schema[name] for name in kept]
    fields += [StructField(name, BinaryType() if name == "block" else StringType()) for name in RESPONSE]
    return rows.mapInArrow(make, StructType(fields))


def _metadata(head: list[str], page: str) -> bytes:
    title, language = TITLE.search(page), LANGUAGE.search(page)
    lines = [f"http-status: {head[0]}"] if head else []
    lines += [f"http-header: {line}" for line in head[1:]]
    if title:
        lines.append(f"title: {visible_text(title[1])}")
    if language:
        lines.append(f"language: {language[1]}")
    for match in LINK.finditer(page):
        target = html.unescape(next(part for part in match.groups() if part is not None))
        lines.append(f"outlink: {target}")
    return "".join(f"{' '.join(line.splitlines())}\r\n" for line in lines).encode()


def derivatives(record_id: str, target: str | None, date: str, block: bytes, payload_digest: str | None) -> Iterator[tuple]:
    """The values of ``DERIVED`` of the metadata and the conversion record of a response."""
    head, payload = split_http(block)
    charset = next((found[1] for line in head if line.lower().startswith("content-type:") and (found := CHARSET.search(line))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    kinds = (("metadata", "application/warc-fields", _metadata(head, page)), ("conversion", "text/plain; charset=utf-8", visible_text(page).encode("utf-8", "replace")))
    for kind, content, own in kinds:
        name, sha = record_name(kind, record_id), digest(own)
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", name),
            ("WARC-Refers-To", record_id),
            ("WARC-Target-URI", target),
            ("WARC-Date", date),
            ("WARC-Refers-To-Payload-Digest", payload_digest),
            ("WARC-Block-Digest", sha),
            ("Content-Type", content),
        ]
        yield kind, name, record_id, target, sha, len(own), write_record(headers, own)


def derive(response_records: DataFrame) -> DataFrame:
    """Two rows per response record: its other columns and those of ``DERIVED``."""
    rows = without_clashes(response_records, RESPONSE, tuple(name for name in DERIVED if name not in RESPONSE))
    kept = [name for name in rows.columns if name not in RESPONSE]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                one
                for values in zip(*(batch.column(batch.schema.get_field_index(name)).to_pylist() for name in RESPONSE), strict=True)
                for one in derivatives(values[0], values[1], values[2], values[3] or b"", values[4])
            ]
            at = pa.array([row for row in range(len(batch)) for _ in range(2)], pa.int64())
            columns = [batch.column(batch.schema.get_field_index(name)).take(at) for name in kept]
            columns += [pa.array([one[k] for one in made], pa.int64() if name == "content_length" else pa.binary() if name == "record" else pa.string()) for k, name in enumerate(DERIVED)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *DERIVED])

    fields = [rows.schema[name] for name in kept]
    fields += [StructField(name, {"content_length": LongType(), "record": BinaryType()}.get(name, StringType())) for name in DERIVED]
    return rows.mapInArrow(make, StructType(fields))
