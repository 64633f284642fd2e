"""WARC derivatives: responses to linked metadata and plain-text conversions.

Each response record gives one metadata record (application/warc-fields) and,
if its payload is text or HTML, one conversion record (text/plain, UTF-8).
Both name the response in WARC-Refers-To, keep its target URI and date, and
carry the digests and HTTP headers of their source; the conversion also names
the metadata record that was made with it.  Record ids are derived from the
response's id, so a task that runs again gives the same records.

Derivatives are UTF-8 text, so Spark's text writer writes them as WARC files
with the record separator as its line separator.

Defined results: a response without a block gives a metadata record that says
so and no conversion; a null target is left out of the headers; an unreadable
HTTP head counts as payload of unknown type (no conversion); repeated
responses give equal records.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderwork.llm.common import maybe_broadcast, written
from ladderwork.llm.extraction import blocks

RESPONSES = "record_id string, target_uri string, date string, block binary"
DERIVED = (
    "source_id string, warc_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, source_block_digest string, "
    "source_payload_digest string, http_status int, http_headers map<string,string>, record string"
)
SEPARATOR = "\r\n\r\n"
#: What stands between two records' texts, the version's last digit left out.
START = b"\r\n\r\nWARC/1."


@dataclass(frozen=True)
class WarcParams:
    #: the date of records built from pages, which have none
    date: str = "2024-01-01T00:00:00Z"
    software: str = "ladderwork"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def named(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(warc_type: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One record without its closing separator."""
    head = {"WARC-Type": warc_type, **fields, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    lines = [f"{k}: {_one_line(v)}" for k, v in head.items() if v is not None]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + SEPARATOR).encode() + block


def _one_line(value: str) -> str:
    return " ".join(value.split())


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        yield head, stream.read(int(head.get("Content-Length", 0)))


def http_parts(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers in lower case and payload (chunks and content encodings undone).

    What cannot be undone stays as it is, and `content-encoding` stays among
    the headers; where it was undone it is gone.
    """
    head, found, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    status = re.match(r"HTTP/\d(?:\.\d)? (\d{3})", first)
    if not found or not status:
        return None, {}, block
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}
    if headers.get("transfer-encoding", "").lower() == "chunked" and (whole := unchunked(payload)) is not None:
        payload = whole
        del headers["transfer-encoding"]
    for coding in reversed([x.strip().lower() for x in headers.get("content-encoding", "identity").split(",")]):
        plain = _undone(payload, coding)
        if plain is None:
            return int(status[1]), headers, payload
        payload = plain
    headers.pop("content-encoding", None)
    return int(status[1]), headers, payload


def unchunked(payload: bytes) -> bytes | None:
    """The body of a chunked message; None if it is not one (an archive may hold the body with the chunks undone)."""
    parts, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        head = payload[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", head):
            return None
        size, at = int(head, 16), end + 2
        if not size:
            return b"".join(parts)
        if at + size > len(payload):
            return None
        parts.append(payload[at : at + size])
        at += size + 2


def _undone(payload: bytes, coding: str) -> bytes | None:
    """The payload without one content encoding; None if that is unknown or does not fit."""
    try:
        if coding in ("", "identity"):
            return payload
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if coding == "deflate":  # with or without the zlib head
            try:
                return zlib.decompress(payload)
            except zlib.error:
                return zlib.decompress(payload, -zlib.MAX_WBITS)
    except (OSError, zlib.error, EOFError):
        pass
    return None


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def _decoded(headers: dict[str, str], payload: bytes) -> tuple[str, str]:
    declared = _CHARSET.search(headers.get("content-type", "").encode()) or _META_CHARSET.search(payload)
    charset = declared[1].decode() if declared else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset.lower()
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def derive_one(record_id: str, target: str | None, date: str, block: bytes | None, p: WarcParams) -> list[tuple]:
    """The rows of DERIVED for one response."""
    block = block or b""
    status, headers, payload = http_parts(block)
    kind = headers.get("content-type", "").partition(";")[0].strip().lower()
    sources = digest(block), digest(payload)
    shared = {"WARC-Target-URI": target, "WARC-Date": date, "WARC-Refers-To": record_id}
    out = []

    def add(warc_type: str, own_id: str, content_type: str, body: bytes, extra: dict[str, str | None]) -> None:
        fields = {"WARC-Record-ID": own_id, **shared, "Content-Type": content_type, **extra}
        text = record(warc_type, fields, body).decode("utf-8", "replace")
        out.append(
            (record_id, warc_type, own_id, record_id, target, date, content_type, len(body), digest(body), *sources, status, headers, text)
        )

    meta_id, text_id = named(record_id, "metadata"), named(record_id, "conversion")
    readable = status is not None and "content-encoding" not in headers and kind in ("text/html", "application/xhtml+xml", "text/plain")
    text, charset = _decoded(headers, payload) if readable else ("", "")
    lines = {
        "software": p.software,
        "source-block-digest": sources[0],
        "source-payload-digest": sources[1],
        "source-payload-length": str(len(payload)),
        "http-status": "" if status is None else str(status),
        **({"charset": charset, "conversion": text_id} if readable else {}),
        **{f"http-{k}": v for k, v in sorted(headers.items())},
    }
    body = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines.items()).encode()
    add("metadata", meta_id, "application/warc-fields", body, {})
    if readable:
        plain = text if kind == "text/plain" else "\n".join(b.text for b in blocks(text))
        extra = {"WARC-Source-Block-Digest": sources[0], "WARC-Source-Payload-Digest": sources[1], "WARC-Concurrent-To": meta_id}
        add("conversion", text_id, "text/plain", plain.encode("utf-8", "replace"), extra)
    return out


def derivatives(responses: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """RESPONSES to DERIVED rows; `record` is the record's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DERIVED.split(", ")]
        for batch in batches:
            rows = [x for r in batch.itertuples(index=False) for x in derive_one(r.record_id, r.target_uri, r.date, r.block, p)]
            if rows:
                out = pd.DataFrame(rows, columns=names)
                out["http_status"] = out["http_status"].astype("Int32")
                yield out

    return responses.select("record_id", "target_uri", "date", "block").mapInPandas(run, DERIVED)


def responses_of_pages(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """Pages (page_id, url, html) as response records, in DataFrame operations."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit(SEPARATOR),
    )
    h = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url").cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(p.date).alias("date"),
        F.concat(head, html).cast("binary").alias("block"),
    )


def write_derivatives(derived: DataFrame, path: str, warc_type: str) -> None:
    """Files of one type of record; each file begins with a record and ends with the separator."""
    rows = derived.where(F.col("warc_type") == warc_type).select("record")
    rows.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def _parsed(piece: bytes) -> tuple[dict[str, str], bytes] | None:
    """Named fields and block of a piece that looks like a record's begin.

    A block that begins with a version line leaves a piece that is a head alone.
    """
    head, _, block = piece.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not lines or not re.fullmatch(rb"(WARC/1\.)?\d", first.strip()):
        return None
    return {k.decode("utf-8", "replace").strip(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}, block


def _length(head: dict[str, str]) -> int:
    size = head.get("Content-Length", "")
    return int(size) if size.isdigit() else 0


def _row_of(head: dict[str, str], block: bytes) -> list:
    size, known = _length(head), head.get("Content-Length", "").isdigit()
    named_fields = [head.get(k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date")]
    return [*named_fields, head, block[:size], known and len(block) >= size and not block[size:].strip()]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or compressed (also a member per record), by Spark's text reader.

    A plain file is read by many tasks, cut where a record may begin.  Which
    of these places are in a record's block is told by walking a file's
    lengths from its begin, over an index of a few numbers a piece; pieces of
    a block that holds such places are put together again, all others are
    parsed where they are read.  Empty files have no records; bytes that
    belong to no record (a file that does not begin with one) are left out.
    `whole` is false for a record that is shorter or longer than it says.
    """
    text = spark.read.option("lineSep", START.decode()).text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value")
    ).withColumn("piece", F.monotonically_increasing_id())

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in map(bytes, batch["value"]):
                found = _parsed(value)
                # of a head alone the four bytes that end it are still to come
                held = None if found is None else len(found[1]) if b"\r\n\r\n" in value else -4
                rows.append((len(value), held is not None, held or 0, _length(found[0]) if found else 0))
            sizes = pd.DataFrame(rows, columns=["size", "begins", "held", "length"])
            yield pd.concat([batch[["file", "at", "piece"]].reset_index(drop=True), sizes], axis=1)

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        """Pieces that continue another's record (or, with -1, none's)."""
        out, record, missing = [], -1, 0
        group = group.sort_values(["at", "piece"])
        for piece, size, begins, held, length in group[["piece", "size", "begins", "held", "length"]].itertuples(index=False):
            if missing <= 0 and begins:
                record, missing = piece, length - held
            else:
                out.append((piece, record))
                missing -= size + len(START)
        return pd.DataFrame(out, columns=["piece", "record"])

    index = pieces.mapInPandas(measured, "file string, at long, piece long, size long, begins boolean, held long, length long")
    moved = index.groupBy("file").applyInPandas(walked, "piece long, record long")
    moved = written(moved, "continued-pieces")
    shared = moved.where("record >= 0").select(F.col("record").alias("piece"), "record").distinct()
    places = maybe_broadcast(moved.unionByName(shared).withColumnRenamed("piece", "of_piece"))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_parsed(value) for value in map(bytes, batch["value"])]
            yield pd.DataFrame([_row_of(*x) for x in found if x is not None], columns=names)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        head, block = _parsed(START.join(map(bytes, group.sort_values(["at", "piece"])["value"])))
        return pd.DataFrame([_row_of(head, block)], columns=names)

    schema = "warc_type string, record_id string, target_uri string, date string, headers map<string,string>, block binary, whole boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    same = F.col("piece") == F.col("of_piece")
    alone = pieces.join(places, same, "left_anti").select("value").mapInPandas(one, schema)
    several = pieces.join(places, same).where("record >= 0").groupBy("record").applyInPandas(joined, schema)
    return alone.unionByName(several)


def page_derivatives(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """DERIVED of all pages, the record's text and its digest among them; the HTTP headers as JSON."""
    out = derivatives(responses_of_pages(pages, p), p)
    return out.withColumn("record_sha256", F.sha2(F.col("record").cast("binary"), 256)).withColumn("http_headers", F.to_json("http_headers"))
