"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Both name the response by WARC-Refers-To and keep its target URI, date and payload digest; the
metadata record also keeps the HTTP status and headers and names the conversion record. Record ids
are derived from the response's id, so a rerun makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, fields map<string,string>, block binary"
_ARROW = pa.schema([(n, pa.string()) for n in ("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest")] + [("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
#: Elements whose content is no text, and elements that begin a line.
HIDDEN = "script|style|template|noscript"
BREAKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
#: Whichever begins first: what a comment holds begins no element, and what an element or a title holds begins no comment.
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<({HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)|(?P<title><title\b[^>]*>(?:(?!<title\b|</head\b|<body\b).)*?</title\s*>)", re.S | re.I)
#: A head ends at its end tag or at the body's begin, both of which can be left out. Only its title is text that does not show.
_HEAD = re.compile(r"<head(?=[\s/>]).*?(?=</head\b|<body\b|\Z)", re.S | re.I)
_HEAD_TITLE = re.compile(r"<title\b[^>]*>(?:(?:(?!<title\b).)*?</title\s*>|[^<]*)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{BREAKS})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """The visible text of a page, a line for each block, without blank lines."""
    page = _HIDDEN.sub(lambda m: m["title"] or " ", page)
    page = _HEAD.sub(lambda m: _HEAD_TITLE.sub(" ", m[0]), page)
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", re.sub(r"\s+", " ", page))))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and payload of an HTTP response; without a header all is payload."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)], body


def decode(payload: bytes, content_type: str) -> str:
    for name in (*_CHARSET.findall(content_type), *_CHARSET.findall(payload[:2048].decode("latin-1")), "utf-8"):
        try:
            return payload.decode(name, "replace")
        except LookupError:
            continue
    return payload.decode("utf-8", "replace")


def derive(record: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(record["block"] or b"")
    by_name = {n.lower(): v for n, v in headers}
    page = decode(payload, by_name.get("content-type", ""))
    text = plain_text(page).encode()
    source = record["record_id"]
    shared = {"refers_to": source, "target_uri": record["target_uri"], "date": record["date"], "payload_digest": record["payload_digest"] or digest(payload)}
    conversion = shared | {"record_id": urn("conversion", source or ""), "warc_type": "conversion", "content_type": "text/plain; charset=utf-8", "block_digest": digest(text), "fields": {}, "block": text}
    title = _TITLE.search(page)
    lines = [f"http-status: {status}", *(f"http-header: {n}: {v}" for n, v in headers), f"source-payload-digest: {shared['payload_digest']}", f"source-block-digest: {record['block_digest'] or digest(record['block'] or b'')}", f"conversion: {conversion['record_id']}"]
    if title:
        lines.append("title: " + " ".join(html.unescape(title[1]).split()))
    lines += ["outlink: " + " ".join(html.unescape(a or b or c).split()) for a, b, c in _LINK.findall(page)]
    fields = ("\r\n".join(lines) + "\r\n").encode()
    metadata = shared | {"record_id": urn("metadata", source or ""), "warc_type": "metadata", "content_type": "application/warc-fields", "block_digest": digest(fields), "fields": {"WARC-Concurrent-To": conversion["record_id"]}, "block": fields}
    return [metadata, conversion]


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 256):
            rows = [r for x in batch.slice(a, 256).to_pylist() if x["warc_type"] == "response" for r in derive(x)]
            yield pa.RecordBatch.from_pylist([r | {"fields": list(r["fields"].items())} for r in rows], _ARROW)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records of ``records`` (RECORD columns); other records give none.

    Nulls: a block counts as empty, missing digests are computed, a missing target URI or date stays missing.
    Equal responses give equal derivatives. Extra columns are ignored.
    """
    return records.select(*_ARROW.names).mapInArrow(_derived, RECORD)


def _responses(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, url, page in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html")), strict=True):
                payload = (page or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                rows.append({"record_id": urn("response", str(id_), url or "", digest(payload)), "warc_type": "response", "refers_to": None, "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "payload_digest": digest(payload), "block_digest": digest(block), "fields": [], "block": block})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each row of a table of raw pages (a null page has an empty payload)."""
    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_responses(date), RECORD)


def serialize(record: dict) -> bytes:
    """One record in the file format."""
    known = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"))
    block = record["block"] or b""
    lines = [VERSION, *(f"{n}: {record[c]}" for n, c in known if record[c] is not None), *(f"{n}: {v}" for n, v in dict(record["fields"] or {}).items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a file's bytes (ValueError where a record is broken off)."""
    names = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type", "warc-payload-digest": "payload_digest", "warc-block-digest": "block_digest"}
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        record: dict = {c: None for c in names.values()} | {"fields": {}}
        size = None
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name.lower() == "content-length":
                size = int(value)
            elif name.lower() in names:
                record[names[name.lower()]] = value.strip()
            else:
                record["fields"][name] = value.strip()
        if size is None or end + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} is broken off")
        record["block"] = data[end + 4 : end + 4 + size]
        yield record
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def _serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([serialize(r) for r in batch.to_pylist()], pa.binary())], ["record"])


def serialized(records: DataFrame) -> DataFrame:
    """The records as file bytes, in a binary column ``record``."""
    return records.select(*_ARROW.names).mapInArrow(_serialized, "record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed or gzip-compressed WARC files; a file is read by one task."""
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = [r | {"fields": list(r["fields"].items())} for r in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
