"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives one ``metadata`` record (application/warc-fields: status, type,
title, all source headers, links) and one ``conversion`` record (text/plain). Both refer to the response
by WARC-Refers-To, the metadata names the conversion by WARC-Concurrent-To, and both
keep the response's target, date, address and payload digest. The metadata's block
has every other HTTP header as ``http-<name>`` and every other WARC header of the
response as ``source-<name>``, repeated ones and their order included. Record ids are
name-based UUIDs, so a task that runs again makes the same records.

Defined results: a null payload counts as empty (empty text, no title); a null URL
leaves WARC-Target-URI out; a response that is not HTTP is taken as the payload
itself; very long and broken pages are read whole, in time in proportion to their
length; of several titles the first one counts, links keep their order and repeats;
repeated rows give repeated records; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import ship

DATE = "2024-01-01T00:00:00Z"
#: Bytes of blocks that the reader passes on at once, one block more at most.
HELD = 16 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:rasterloom:warc")
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|section|article|header|footer|nav|main|aside|blockquote|pre|form|figure|figcaption|address)\b[^>]*>", re.I)
_CELL = re.compile(r"</?(?:td|th)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*>", re.I)
_ANCHOR, _HREF, _BARE = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"[^\s>]+")
_DIGITS = re.compile(r"&#([0-9]{9,})|&#[xX]([0-9a-fA-F]{9,})")
_RUN = re.compile(r"[ \t\f\v\xa0]+")

RECORD = "record_id string, type string, target string, date string, address string, payload_digest string, block_digest string, content_type string, block binary, headers array<struct<name:string,value:string>>"
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_TYPES = {"block": pa.binary(), "headers": _HEADERS}
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
#: WARC headers that the derived records have in their own place.
_CARRIED = {"warc-target-uri", "warc-date", "warc-ip-address", "warc-record-id", "warc-payload-digest"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def name(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(map(str, parts)))}>"


def resolved(text: str) -> str:
    """Entities resolved; numbers of any length are taken as their first digits, which are beyond all characters already."""
    short = lambda m: f"&#{m[1].lstrip('0')[:9] or '0'}" if m[1] else f"&#x{m[2].lstrip('0')[:9] or '0'}"
    return entities.unescape(_DIGITS.sub(short, text))


def _tags(pattern: re.Pattern, to: str, page: str) -> str:
    """``pattern`` replaced up to the last end of a tag: behind it every start would be read to the end of the page."""
    cut = page.rfind(">") + 1
    return pattern.sub(to, page[:cut]) + page[cut:]


def plain(page: str) -> str:
    """Visible text: one line for each block, entities resolved, spaces collapsed."""
    page = _DROP.sub(" ", page)
    page = re.sub(r"[\r\n]+", " ", page)
    page = _tags(_CELL, "\t", _tags(_BLOCK, "\n", page))
    page = resolved(_tags(_TAG, "", page))
    lines = (_RUN.sub(" ", line).strip() for line in page.split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str:
    """Text of the first title element, or nothing."""
    found = _TITLE.search(page)
    start = page.find(">", found.end()) + 1 if found else 0
    end = _TITLE_END.search(page, start) if start else None
    return " ".join(resolved(_tags(_TAG, "", page[start : end.start()])).split()) if end else ""


def links_of(page: str) -> list[str]:
    """Targets of the anchors, in one pass."""
    out: list[str] = []
    at, closes = 0, {"\"": True, "'": True}  # whether that quote can still be closed
    while found := _ANCHOR.search(page, at):
        end = page.find(">", found.end())
        href = _HREF.search(page, found.end(), end if end >= 0 else len(page))
        if not href:
            if end < 0:
                break
            at = end + 1
            continue
        at = href.end()
        quote = page[at : at + 1]
        close = page.find(quote, at + 1) if closes.get(quote) else -1
        if close >= 0:
            out.append(page[at + 1 : close])
            at = close + 1
            continue
        closes[quote] = False
        if bare := _BARE.match(page, at):
            out.append(bare[0])
            at = bare.end()
    return [resolved(x) for x in out]


def header_fields(lines: list[str]) -> list[tuple[str, str]]:
    """Names (lower case) and values of header lines; a line that begins with a space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line:
            k, _, v = line.partition(":")
            out.append((k.strip().lower(), v.strip()))
    return out


def http_headers(block: bytes) -> list[tuple[str, str]]:
    """All headers of an HTTP response, in order."""
    return header_fields(block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]) if block.startswith(b"HTTP/") else []


def split_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers (lower-case names) and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None, {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    words = lines[0].split(" ")
    headers = dict(header_fields(lines[1:]))
    return int(words[1]) if len(words) > 1 and words[1].isdigit() else None, headers, payload


def decode(payload: bytes, headers: dict[str, str]) -> str:
    found = re.search(r"charset=[\"']?([\w.:-]+)", headers.get("content-type", ""), re.I) or re.search(rb"<meta[^>]+charset=[\"']?([\w.:-]+)", payload[:2048], re.I)
    charset = found[1] if found else "utf-8"
    charset = charset.decode("ascii") if isinstance(charset, bytes) else charset
    try:
        return payload.decode(charset, "replace")
    except (LookupError, ValueError):  # no charset of texts
        return payload.decode("utf-8", "replace")


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    lines = [f"{k}: {re.sub('[\r\n]+', ' ', v)}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (headers with lower-case names, block) of a WARC file, gzipped or not."""
    return ((dict(fields), block) for fields, block in parse_fields(data))


def parse_fields(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Records with all their headers in order; beside ``data`` itself only one of them is held at a time."""
    stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        lines = []
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"no WARC record at byte {at}")
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        headers = header_fields(lines)
        yield headers, stream.read(int(dict(headers)["content-length"]))


def response(page_id: object, url: str | None, page: str | None, date: str = DATE) -> tuple:
    """A RECORD row for a stored page."""
    payload = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return name("response", page_id, url), "response", url, date, None, digest(payload), digest(block), "application/http; msgtype=response", block, None


def derive(record_id: str, target: str | None, date: str | None, address: str | None, payload_digest: str | None, block: bytes | None, source_headers: list[dict[str, str]] | None = None) -> dict[str, object]:
    """The two derived records of a response, and what they say."""
    status, headers, payload = split_http(block or b"")
    page = decode(payload, headers)
    text = plain(page).encode("utf-8", "replace")
    title, links = title_of(page), links_of(page)
    meta_id, conv_id = name("metadata", record_id), name("conversion", record_id)
    payload_digest = payload_digest or digest(payload)
    fields = [("http-status", status), ("http-content-type", headers.get("content-type")), ("title", title), ("payload-length", len(payload)), ("text-length", len(text))]
    every = http_headers(block or b"")
    last = max((k for k, (x, _) in enumerate(every) if x == "content-type"), default=-1)  # that is http-content-type already
    fields += [(f"http-{k}", v) for at, (k, v) in enumerate(every) if at != last]
    fields += [(f"source-{h['name']}", h["value"]) for h in source_headers or [] if h["name"] not in _CARRIED]
    fields += [("outlink", x) for x in links]
    meta = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in fields if v is not None).encode("utf-8", "replace")
    source = [("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-IP-Address", address), ("WARC-Refers-To", record_id), ("WARC-Payload-Digest", payload_digest)]
    return {
        "metadata_id": meta_id, "conversion_id": conv_id, "payload_digest": payload_digest, "metadata_digest": digest(meta), "conversion_digest": digest(text),
        "status": status, "title": title, "n_links": len(links), "text": text.decode("utf-8"),
        "metadata": serialise([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *source, ("WARC-Concurrent-To", conv_id), ("WARC-Block-Digest", digest(meta)), ("Content-Type", "application/warc-fields")], meta),
        "conversion": serialise([("WARC-Type", "conversion"), ("WARC-Record-ID", conv_id), *source, ("WARC-Block-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text),
    }


def responses(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """Response records (RECORD) of a table of stored pages, beside the key."""
    ship(spark)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 512):
                batch = whole.slice(cut, 512)
                rows = [response(*r, date) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                columns = [pa.array(c, _TYPES.get(k, pa.string())) for k, c in zip(_NAMES, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *_NAMES])

    return pages.select(F.col(key).alias("key"), url, page).mapInArrow(run, f"key {kind}, {RECORD}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response records (RECORD) of the WARC files under ``path``; the key is the file's path."""
    ship(spark)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = ("key", *_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(k, pa.string())) for k, c in zip(names, zip(*rows, strict=True), strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for fields, block in parse_fields(content):
                    h = dict(fields)
                    rows.append((file, *(h.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-ip-address", "warc-payload-digest", "warc-block-digest", "content-type")), block, [{"name": k, "value": v} for k, v in fields]))
                    held += len(block)
                    if len(rows) == 512 or held > HELD:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, f"key string, {RECORD}")


DERIVED = ("metadata_id", "conversion_id", "payload_digest", "metadata_digest", "conversion_digest", "status", "title", "n_links", "text", "metadata", "conversion")


def derivatives(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Every response record with its derived records (whole, as binary) and what they say."""
    ship(spark)
    kind = records.schema["key"].dataType.simpleString()
    schema = f"key {kind}, record_id string, target string, date string, " + ", ".join(f"{c} {dict(status='int', n_links='long', metadata='binary', conversion='binary').get(c, 'string')}" for c in DERIVED)
    types = {"status": pa.int32(), "n_links": pa.int64(), "metadata": pa.binary(), "conversion": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 512):
                batch = whole.slice(cut, 512)
                rows = [derive(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("record_id", "target", "date", "address", "payload_digest", "block", "headers")), strict=True)]
                columns = [pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in DERIVED]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "record_id", "target", "date")), *columns], ["key", "record_id", "target", "date", *DERIVED])

    chosen = records.where("type = 'response'").select("key", "record_id", "target", "date", "address", "payload_digest", "block", "headers")
    return chosen.mapInArrow(run, schema)


def write(derived: DataFrame, path: str) -> None:
    """WARC files of the metadata and conversion records, written by Spark's own committer.

    Both blocks are UTF-8, so a record is one value of the text writer, whose separator
    is the pair of line ends that closes a record.
    """
    record = F.explode(F.array(F.decode("metadata", "UTF-8"), F.decode("conversion", "UTF-8")))
    derived.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """For each page the ids, links and digests of its three records."""
    done = derivatives(spark, responses(spark, pages))
    return done.select(
        F.col("key").alias("page_id"), F.col("record_id").alias("response_id"), "metadata_id", "conversion_id", "target", "date", "payload_digest", "metadata_digest",
        "conversion_digest", "status", "title", "n_links", F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"),
        F.length("metadata").cast("long").alias("metadata_bytes"), F.length("conversion").cast("long").alias("conversion_bytes"),
    )
