"""WARC derivatives: metadata and plain-text conversion records from response records.

A response becomes two records, as in common web archives: a metadata record, whose block is JSON with
the HTTP status and headers, title, language and links of the page, and a conversion record, whose
block is the page's visible text. Both name the response in WARC-Refers-To and keep its target URI
and date; their digests are those of their own blocks, and the metadata holds that of the response's
payload as it was sent. A record id is a UUID made of its content, so a task that runs again makes the
same records.

A page is read by one forward scan, so time grows with its length, however broken it is: a tag ends at the
first ">", an element whose text is dropped at its first closing tag (without one, nothing is dropped), a
comment without an end reaches to the end. A payload sent in chunks is put together, unpacked (all members) if its headers say gzip or deflate and it
is, up to MOST_UNPACKED bytes, and decoded by the charset that they or a meta tag name, else as UTF-8, with U+FFFD for what is none.

A null or empty block gives an empty text and no links; a response without HTTP headers is taken as
a bare payload. Headers may repeat and keep their order. Repeated responses give repeated records. Rows
never meet, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_FLAGS = re.I | re.A
_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-z][a-z0-9]*))", _FLAGS)
_ATTRIBUTE = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", _FLAGS)
#: Elements whose text is not visible; what is in the first two is no markup either.
_RAW, _HIDDEN = ("script", "style"), ("head", "noscript", "template", "svg")
_CLOSING = {name: re.compile(rf"</{name}\s*>", _FLAGS) for name in (*_RAW, *_HIDDEN, "title")}
_BLOCKS = frozenset("p div br hr h1 h2 h3 h4 h5 h6 li ul ol table tr td th nav article section header footer main aside blockquote pre form body html title dd dt dl figure figcaption option".split())
_LINKING = frozenset("a link img script iframe area source".split())
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([a-z0-9_:.-]{1,40})", re.I)

#: Bytes that a payload may unpack to; one that would be larger is kept packed.
MOST_UNPACKED = 1 << 28
_CHUNK_SIZE = re.compile(rb"([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]{0,4096})?\r\n")

_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_digest string, source_block_digest string, source_verified boolean, source_headers string, content string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode()).digest(), version=4)}>"


@dataclass
class Page:
    """What a page shows and names."""

    text: str = ""
    title: str | None = None
    language: str | None = None
    links: list[dict[str, str]] = field(default_factory=list)


def _tidy(text: str) -> Iterator[str]:
    return filter(None, (" ".join(line.split()) for line in html.unescape(text).split("\n")))


def parsed(page: str) -> Page:
    """The visible text, one line per block, the first title and language, and links in order of appearance: tag, attribute and url."""
    out, shown, at, hidden_to = Page(), [], 0, 0
    unclosed: set[str] = set()  # elements that no closing tag follows any more

    def end_of(name: str, start: int) -> int:
        if name not in unclosed:
            if found := _CLOSING[name].search(page, start):
                return found.start()
            unclosed.add(name)
        return -1

    while opened := _OPEN.search(page, at):
        if at >= hidden_to:
            shown.append(page[at : opened.start()])
        end = page.find("-->", opened.end()) + 2 if opened[1] else page.find(">", opened.end())
        if opened[1] and end == 1:
            at = len(page)
            break
        if end < 0:
            at = opened.start()
            break
        at = end + 1
        name = (opened[3] or "").lower()
        if not name:
            continue
        if name in _BLOCKS and at > hidden_to:
            shown.append("\n")
        if opened[2]:
            continue
        if name in _LINKING or (name == "html" and out.language is None):
            attributes = [(key.lower(), "".join(values)) for key, *values in _ATTRIBUTE.findall(page, opened.end(), end)]
            if name == "html":
                out.language = next((value.lower() for key, value in attributes if key == "lang" and value), None)
            else:
                out.links += ({"path": f"{name.upper()}@/{key}", "url": html.unescape(value).strip()} for key, value in attributes if key in ("href", "src"))
        if name == "title" and out.title is None and (stop := end_of(name, at)) >= 0:
            out.title = " ".join(_tidy(page[at:stop])).strip()
        elif name in _RAW and (stop := end_of(name, at)) >= 0:
            at = stop
        elif name in _HIDDEN and (stop := end_of(name, at)) >= 0:
            hidden_to = max(hidden_to, stop)
    if at >= hidden_to:
        shown.append(page[at:])
    out.text = "\n".join(_tidy("".join(shown)))
    return out


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(name.strip(), value.strip()) for name, _, value in (line.partition(":") for line in lines)], payload


def dechunked(payload: bytes) -> bytes:
    """A payload sent in chunks, put together: sizes in hexadecimal, extensions and trailers left out. One that does not begin so is returned as it is, one that breaks off as far as it goes."""
    out, at = [], 0
    while found := _CHUNK_SIZE.match(payload, at):
        size, start = int(found[1], 16), found.end()
        if not size:
            return b"".join(out)
        out.append(payload[start : start + size])
        at = start + size + (2 if payload[start + size : start + size + 2] == b"\r\n" else 0)
    return b"".join(out) if out and at else payload


def unpacked(payload: bytes, most: int = MOST_UNPACKED) -> bytes | None:
    """All members of a gzip payload, or a zlib or raw deflate one, as far as they are whole; None where it is none of these or unpacks to more than `most` bytes."""
    for bits in (47, -15):
        out, rest, size = [], payload, 0
        try:
            while rest:
                member = zlib.decompressobj(bits)
                out.append(member.decompress(rest, most - size + 1))
                size += len(out[-1])
                if size > most:
                    return None
                rest = member.unused_data
                bits = 31 if bits == 47 else bits  # only gzip has further members
            return b"".join(out)
        except zlib.error:
            if out:
                return b"".join(out)
    return None


def payload_text(headers: list[tuple[str, str]], payload: bytes) -> str:
    """A payload put together, unpacked and decoded."""
    of = {name.lower(): value for name, value in headers}
    if "chunked" in of.get("transfer-encoding", "").lower():
        payload = dechunked(payload)
    if of.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        payload = payload if (plain := unpacked(payload)) is None else plain
    named = _CHARSET.search(of.get("content-type", "").encode()) or _CHARSET.search(payload[:1024])
    try:
        charset = codecs.lookup(named[1].decode()).name if named else "utf-8"
        # Some codecs let lone surrogates through.
        return payload.decode(charset, "replace").encode("utf-8", "replace").decode()
    except (LookupError, UnicodeError):  # an unknown charset, or a codec that is none of text
        return payload.decode("utf-8", "replace")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, block) response records of fetched pages."""
    payload = F.coalesce(html_col, F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    url = F.coalesce(url_col, F.lit(""))
    hashed = F.md5(F.concat_ws("|", F.lit("response"), F.col(id_col).cast("string"), url, payload))
    # A version-4 UUID has fixed bits at two places.
    name = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hashed, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-8$4-$5"), F.lit(">"))
    return pages.select(F.col(id_col).alias("page_id"), name.alias("record_id"), url.alias("target_uri"), F.lit(DATE).alias("warc_date"), F.concat(head, payload).alias("block"))


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, source, uri, date, named, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            status, headers, payload = http_parts(block)
            page, source_digest, block_digest = parsed(payload_text(headers, payload)), digest(payload), digest(block)
            # A digest of another kind cannot be checked here.
            verified = named.lower() == block_digest.lower() if named and named.lower().startswith("sha1:") else None
            meta = {
                "status": status,
                "headers": headers,
                "payload_digest": source_digest,
                "title": page.title,
                "language": page.language,
                "links": page.links,
            }
            made = (("metadata", "application/json", json.dumps(meta, ensure_ascii=False)), ("conversion", "text/plain", page.text))
            for kind, content_type, content in made:
                data = content.encode()
                rows.append((page_id, kind, record_id(kind, source, content), source, uri, date, content_type, len(data), digest(data), source_digest, block_digest, verified, "\r\n".join(f"{k}: {v}" for k, v in headers), content))
        columns = list(zip(*rows, strict=True)) or [[]] * 14
        fields = [f.split() for f in _SCHEMA.split(", ")]
        names = ["page_id", *(name for name, _ in fields)]
        types = [batch.schema.field(0).type, *({"long": pa.int64(), "boolean": pa.bool_()}.get(kind, pa.string()) for _, kind in fields)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records (record_id, target_uri, warc_date, block), as `responses` or `read_records` give them.

    Where there is a record_type, other records than responses make none. page_id is the records' own, or else the source's record id. A block_digest that the source names is compared
    with its block's: source_verified is null where it names none of this kind."""
    if "record_type" in records.columns:
        records = records.filter("record_type = 'response'")
    has = lambda c, other: F.col(c) if c in records.columns else other.alias(c)
    rows = records.select(has("page_id", F.col("record_id")), "record_id", "target_uri", "warc_date", has("block_digest", F.lit(None).cast("string")), F.coalesce(F.col("block").cast("binary"), F.lit(b"")).alias("block"))
    return rows.mapInArrow(_derive, StructType(rows.schema.fields[:1] + StructType.fromDDL(_SCHEMA).fields))


def write_responses(records: DataFrame, path: str) -> None:
    """Response records whose blocks are text as WARC text files."""
    head = F.concat_ws("\r\n", F.lit(VERSION), F.lit("WARC-Type: response"), *(F.concat(F.lit(f"{name}: "), F.col(c)) for name, c in (("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"))), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    records.select(F.concat(head, F.lit("\r\n\r\n"), F.col("block")).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Derivative records as WARC text files."""
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))),
    )
    records.select(F.concat(head, F.lit("\r\n\r\n"), F.col("content")).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_READ = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, complete boolean, block binary"
_MARK = b"WARC/1."


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the pieces of files between version marks. A mark inside a block is not a record's: by its length the block reaches beyond it."""
    names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest")
    columns, types = zip(*(f.split() for f in _READ.split(", ")), strict=True)
    schema = pa.schema([(c, {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for c, t in zip(columns, types, strict=True)])
    rows: list[tuple] = []
    held: list[bytes] = []  # a record whose block is not complete yet
    held_file, size, missing, made = None, 0, 0, 0

    def finish() -> None:
        nonlocal made
        if held:
            head, _, block = b"".join(held).partition(b"\r\n\r\n")
            of = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                of.setdefault(name.strip().lower(), value.strip())
            rows.append((*(of.get(n) for n in names), missing <= 0, block[:size] if size is not None else block))
            made += len(block)
            held.clear()

    for batch in batches:
        for file, piece in zip(batch.column(0), batch.column(1), strict=True):
            file, piece = file.as_py(), piece.as_py()
            if held and file == held_file and missing > 0:
                held.append(_MARK + piece)
                missing -= len(_MARK) + len(piece)
                continue
            head, gap, block = piece.partition(b"\r\n\r\n")
            if not gap or not re.search(rb"(?im)^warc-record-id:", head):
                continue
            finish()
            length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
            held_file, size = file, int(length[1]) if length else None
            missing = 0 if size is None else size - len(block)
            held.append(piece)
            if made > 4 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema)
                rows.clear()
                made = 0
    finish()
    yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, warc_date, content_type, block_digest, complete, block) of WARC files of version 1.x, plain or compressed; blocks keep their bytes.

    Files are split at version marks, so one large plain file is read by many tasks. Pieces without a record id are
    no records. complete is false where a block is shorter than its header says: the file was cut, or the block of
    a plain file holds a version mark just where the file is split between two tasks (then set
    spark.sql.files.maxPartitionBytes above the size of the files)."""
    raw = spark.read.option("lineSep", _MARK.decode()).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(_records, _READ)
