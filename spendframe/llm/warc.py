"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response yields a conversion record (its visible text) and a metadata record (a
JSON object with the HTTP status and headers, title, links and lengths). Both refer to
the response by its identifier and carry its target, date and payload digest, and each
names the other, so either can be followed back or across. Identifiers are derived from
the response's and the kind, so a rerun makes the same ones. A source's own WARC headers
are carried in the metadata record, and its payload digest is kept where it has one.

Defined cases: a response without HTTP head is all payload; a null block is empty and
yields empty text; a null target or date is left out of headers and null in columns; an
unclosed comment, script or style runs to the end; repeated responses give equal
records; a response without identifier is named by its target, date and digest; a kept
column with a record column's name gets an underscore; records that are cut short or
gzip members that cannot be read are left out and counted by ``damaged_records``; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import frames

DATE = "2024-01-01T00:00:00Z"
SCHEMA = ("record_id string, warc_type string, refers_to string, concurrent_to string, target_uri string, "
          "warc_date string, content_type string, content_length long, block_digest string, "
          "source_digest string, block binary")
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 16
_HIDDEN = {"script", "style", "template", "noscript"}
_BREAKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3",
           "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title",
           "tr", "ul"}
_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9:-]*)|[!?/])")
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CLOSE = {name: re.compile(f"</{name}", re.IGNORECASE) for name in _HIDDEN}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{record_id} {kind}')}>"


def visible(page: str) -> tuple[str, str, list[str]]:
    """Text in lines, title and link targets of a page, in one walk over its tags."""
    parts: list[str] = []
    links: list[str] = []
    title: list[str] | None = None
    at = 0
    while True:
        tag = _TAG.search(page, at)
        parts.append(page[at : tag.start() if tag else len(page)])
        if title is not None and len(title) == 1:
            title.append(parts[-1])
        if tag is None:
            break
        close = page.find("-->" if tag[1] else ">", tag.end())
        after = len(page) if close < 0 else close + (3 if tag[1] else 1)
        name = (tag[3] or "").lower()
        if name in _HIDDEN and not tag[2]:
            end = _CLOSE[name].search(page, after)
            after = end.start() if end else len(page)
        elif name == "a" and not tag[2]:
            found = _HREF.search(page, tag.end(), after)
            if found:
                links.append(html.unescape(found[1] or found[2] or found[3] or ""))
        elif name == "title" and not tag[2] and title is None:
            title = [""]
        if name in _BREAKS:
            parts.append("\n")
        at = after
    text = html.unescape("".join(parts))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return ("\n".join(line for line in lines if line), " ".join(html.unescape("".join(title or [])).split()), links)


def split_http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers and payload of a response block."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [[name.strip(), value.strip()] for name, _, value in (line.partition(":") for line in rest)], payload


def _text_of(payload: bytes, headers: list[list[str]]) -> str:
    kind = next((value for name, value in headers if name.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two records (``SCHEMA``) for each response.

    ``responses`` has record_id, target_uri, warc_date and block (binary), and may have
    source_headers, a map of WARC headers by their name in lower case. Of its other columns
    those named in ``keep`` are repeated on both records.
    """
    names = list(_NAMES)
    for name in keep:
        names.append(frames.fresh(names, name))
    kept = [f"`{own}` {dict(responses.dtypes)[name]}" for own, name in zip(names[len(_NAMES) :], keep, strict=True)]
    about_source = F.col("source_headers") if "source_headers" in responses.columns else F.lit(None).cast("map<string,string>")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for record_id, uri, date, block, about in zip(*(column.to_pylist() for column in batch.columns[:5]), strict=True):
                status, headers, payload = split_http(block or b"")
                own_headers = dict(about or {})
                source = own_headers.get("warc-payload-digest") or digest(payload)
                text, title, links = visible(_text_of(payload, headers))
                plain = text.encode("utf-8", "replace")
                named = f"unnamed {uri} {date} {digest(block or b'')}" if record_id is None else record_id
                conversion, metadata = derived_id(named, "conversion"), derived_id(named, "metadata")
                facts = {"status": status, "headers": headers, "title": title, "links": links,
                         "payload_digest": source, "payload_length": len(payload),
                         "text_digest": digest(plain), "conversion": conversion}
                if own_headers:
                    facts["source_headers"] = own_headers
                about = json.dumps(facts, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
                for kind, own, other, content, body in (
                        ("metadata", metadata, conversion, "application/json", about),
                        ("conversion", conversion, metadata, "text/plain; charset=utf-8", plain)):
                    rows.append((own, kind, record_id, other, uri, date, content, len(body), digest(body), source, body))
            if rows:
                kinds = [pa.int64() if name == "content_length" else pa.binary() if name == "block" else pa.string() for name in _NAMES]
                source_row = pa.array([i for i in range(len(batch)) for _ in range(2)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    + [column.take(source_row) for column in batch.columns[5:]], names=names)

    columns = [F.col(name) for name in ("record_id", "target_uri", "warc_date", "block")] + [about_source.alias("source_headers")]
    columns += [F.col(f"`{name}`").alias(own) for own, name in zip(names[len(_NAMES) :], keep, strict=True)]
    return frames.texts(responses, *columns).mapInArrow(build, ", ".join([SCHEMA, *kept]))


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of page_id, url and html; ids come from page and target."""
    named = F.md5(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), F.col("url")))
    parts = [F.substring(named, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head, payload).alias("block"), "page_id")


def serialized(records: DataFrame, compress: bool = True) -> DataFrame:
    """Column ``record``: each derived record as bytes of a WARC file, one gzip member each.

    Members of one partition put together are a valid file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fields = (("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]),
                          ("WARC-Refers-To", row["refers_to"]), ("WARC-Concurrent-To", row["concurrent_to"]),
                          ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["warc_date"]),
                          ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", row["source_digest"]),
                          ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"])))
                head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
                record = head.encode() + b"\r\n" + (row["block"] or b"") + b"\r\n\r\n"
                out.append(gzip.compress(record, mtime=0) if compress else record)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return records.select(*_NAMES).mapInArrow(write, "record binary")


def _members(data: bytes) -> Iterator[bytes | None]:
    """What each gzip member holds, or None for one that cannot be read to its end."""
    view, at = memoryview(data), 0
    while at < len(data):
        member = zlib.decompressobj(wbits=31)
        parts, end = [], at
        try:
            # In pieces, as what is left of the input after a member is copied.
            while not member.eof and end < len(data):
                parts.append(member.decompress(view[end : end + _READ]))
                end = min(end + _READ, len(data))
        except zlib.error:
            pass
        if member.eof:
            yield b"".join(parts)
            at = end - len(member.unused_data)
        else:
            yield None
            at = data.find(b"\x1f\x8b\x08", at + 3)
            if at < 0:
                return


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | None]:
    """Headers (names in lower case) and block of each record of a plain or gzipped file.

    None stands for a record that is cut short or has no length, or for a gzip member
    that is damaged; reading goes on at the next member.
    """
    if data[:2] != b"\x1f\x8b":
        yield from _plain_records(data)
        return
    for member in _members(data):
        if member is None:
            yield None
        else:
            yield from _plain_records(member)


def _plain_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | None]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or end + 4 + int(size) > len(data):
            yield None
            return
        yield headers, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size) + 4


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file that can be read whole."""
    return (record for record in records_of(data) if record is not None)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, for ``derive``. A file is one row, of 2 GB at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [(headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), block,
                         list(headers.items()))
                        for headers, block in parse(data.as_py()) if headers.get("warc-type") == "response"]
                if rows:
                    kinds = (*[pa.string()] * 3, pa.binary(), pa.map_(pa.string(), pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["record_id", "target_uri", "warc_date", "block", "source_headers"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "record_id string, target_uri string, warc_date string, block binary, "
                                  "source_headers map<string, string>")


def damaged_records(spark: SparkSession, path: str) -> DataFrame:
    """Column path and, for each file, its records read whole and its damaged ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[record is not None for record in records_of(data.as_py())] for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(whole) for whole in found], pa.int64()),
                 pa.array([len(whole) - sum(whole) for whole in found], pa.int64())], names=["path", "whole", "damaged"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(count, "path string, whole long, damaged long")
