"""Web archives: writing records with revisits, and a reader that salvages damaged files.

Writing. Each page becomes a response record, or a revisit of the page of least key with the same
payload. A record is compressed to gzip members of its own, as is usual for such archives, and the
files are written by Spark's text writer, so any file system Spark can write to will do. A member
ends in the high byte of its length, zero for members below 16 MiB (longer records take several
members); that last byte is written as the line separator.

Reading. A file is parsed from the start. A record counts if its version line, fields and length are
sound and its digests, where it has any, agree; otherwise it is quarantined: the reader looks for
the next member that can be decompressed or the next version line at the start of a line, whichever
comes first, goes on there, and logs the bytes between as a gap with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packlens.llm.common import staged

CRLF = "\r\n"
RECORDS_PER_FILE = 20_000
MEMBER_BYTES = 8 << 20
#: Files up to this size reach a task as one value; longer ones are read from their path in pieces.
WHOLE_FILE_BYTES = 64 << 20
#: Longer records are taken for damaged.
LONGEST_RECORD = 1 << 30
_PIECE = 1 << 20
_FIRST_PIECE = 1 << 14
_FETCH = 1 << 22
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_LATER = re.compile(rb"\nWARC/1\.[01]\r?\n")
_ID = "urn:page:"


# ---------------------------------------------------------------------------- writing


def base32_sha1(data: Column) -> Column:
    """SHA-1 as bare upper-case base32: the 40 hex digits in eight groups of 20 bits, four digits each."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(record), the bytes of one record as text for each page.

    Payloads are the html in UTF-8, empty for null. Of pages with equal payloads of at least
    ``least_bytes`` the one of least key is the response and the others revisit it; rows that repeat
    its key are responses too. Pages with a null key come after all others. Control characters in
    an address become spaces.
    """
    page = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    page = page.withColumn("bytes", F.octet_length("payload")).withColumn("same", F.sha2("payload", 256))
    # Keyed by the digest alone: copies are folded in the tasks, and the join's large partitions can be split.
    firsts = staged(page.filter(F.col("bytes") >= least_bytes).groupBy("same").agg(F.min("id").alias("first")), "firsts")
    joined = page.join(firsts.hint("shuffle_hash"), "same", "left")
    again = F.col("first").isNotNull() & (F.col("bytes") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x1f]", " ")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return joined.select(F.concat(head, F.lit(CRLF * 2), block, F.lit(CRLF * 2)).alias("record"))


def write(rows: DataFrame, path: str, *, gzip: bool = True, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes ``rows`` (record) as archive files below ``path``."""
    writer = rows
    separator = CRLF * 2
    if gzip:

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array([members(value.as_buffer().to_pybytes())[:-1]], pa.binary())], ["record"])

        writer = rows.select(F.col("record").cast("binary")).mapInArrow(packed, "record binary").select(F.col("record").cast("string"))
        separator = "\x00"
    else:
        writer = rows.select(F.substring("record", F.lit(1), F.length("record") - 4).alias("record"))
    writer.write.option("lineSep", separator).option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


def members(record: bytes) -> bytes:
    """The record as one gzip member, or as several if it is long."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(record[at : at + MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


# ---------------------------------------------------------------------------- reading


class Held:
    """A file that is one value."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def read(self, start: int, n: int) -> bytes:
        return self.data[start : start + n]

    def find(self, what: bytes, start: int) -> int:
        return self.data.find(what, start)


class Opened:
    """A file that is read in pieces from its path. The last piece is kept, so what is read on is fetched once."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.held, self.begin = b"", 0

    def read(self, start: int, n: int) -> bytes:
        end = min(start + n, self.size)
        if start >= end:
            return b""
        kept = self.begin + len(self.held)
        if not self.begin <= start <= kept:
            self.held, self.begin = self._fetch(start, end), start
        elif end > kept:
            self.held, self.begin = self.held[start - self.begin :] + self._fetch(kept, end), start
        return self.held[start - self.begin : end - self.begin]

    def _fetch(self, start: int, end: int) -> bytes:
        return self.file.read_at(min(max(end - start, _FETCH), self.size - start), start)

    def find(self, what: bytes, start: int) -> int:
        while start < self.size:
            found = self.read(start, _PIECE).find(what)
            if found >= 0:
                return start + found
            start += _PIECE - len(what) + 1
        return -1


@dataclass
class Record:
    offset: int
    fields: dict[str, str]
    block: bytes
    end: int = 0
    digest: str = ""
    payload: bytes = field(default=b"", repr=False)


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


class Unsound(ValueError):
    """A record that fails a check."""


def salvage(source: Held | Opened) -> Iterator[Record | Gap]:
    """Records and gaps of a file, in order; members and plain records may stand side by side."""
    at, bad, why = 0, -1, ""
    begun, start = b"", 0  # a record whose later members follow
    ahead = [-1, -1]  # the next first bytes of a member and the next version line, as far as looked for

    def resume(place: int) -> int:
        if ahead[0] < place:
            found = source.find(_MAGIC, place)
            ahead[0] = found if found >= 0 else source.size
        if ahead[1] < place:
            ahead[1] = _next_version(source, place)
        return min(ahead)

    while at < source.size:
        if source.read(at, 3) != _MAGIC:
            if begun:
                if bad < 0:
                    bad, why = start, "block is cut"
                begun = b""
            try:
                record = _parse(source, at)
            except Unsound as problem:
                if bad < 0:
                    bad, why = at, str(problem)
                at = resume(at + 1)
                continue
            if bad >= 0:
                yield Gap(bad, at, why)
                bad = -1
            yield record
            at = record.end
            continue
        try:
            content, end = _inflate(source, at)
        except Unsound as problem:
            if bad < 0:
                bad, why = start if begun else at, str(problem)
            begun = b""
            at = resume(at + 1)
            continue
        fresh = _VERSION.match(content) is not None
        if begun and fresh:  # the record before never came to its end
            if bad < 0:
                bad, why = start, "block is cut"
            begun = b""
        if not begun:
            start = at
        inner, begun = Held(begun + content), b""
        place = 0
        while place < inner.size:
            try:
                record = _parse(inner, place)
            except Unsound as problem:
                if str(problem) in ("block is cut", "header does not end") and inner.size - place < LONGEST_RECORD and end < source.size:
                    begun = inner.read(place, inner.size)
                    break
                if bad < 0:
                    bad, why = start, str(problem)
                place = _next_version(inner, place + 1)
                continue
            if bad >= 0:
                yield Gap(bad, start, why)
                bad = -1
            place = record.end
            record.offset, record.end = start, end
            yield record
        at = end
    if begun and bad < 0:
        bad, why = start, "block is cut"
    if bad >= 0:
        yield Gap(bad, source.size, why)


def _next_version(source: Held | Opened, start: int) -> int:
    """Where the next version line starts a line; the end of the file if nowhere."""
    while (found := source.find(b"\nWARC/1.", start - 1)) >= 0:
        if _VERSION.match(source.read(found + 1, 12)):
            return found + 1
        start = found + 2
    return source.size


def _parse(source: Held | Opened, at: int) -> Record:
    """The record that starts at ``at``; raises Unsound with the check it fails."""
    head = source.read(at, 2048)
    if not _VERSION.match(head):
        raise Unsound("no version line")
    while (stop := head.find(b"\r\n\r\n")) < 0 and len(head) < min(LONGEST_RECORD, source.size - at):
        if _LATER.search(head):
            raise Unsound("bad header field")
        head = source.read(at, 2 * len(head))
    if stop < 0:
        raise Unsound("header does not end")
    fields: dict[str, str] = {}
    for line in head[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Unsound("bad header field")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 12):
        raise Unsound("bad length")
    start, n = at + stop + 4, int(length)
    if n > LONGEST_RECORD or start + n > source.size:
        raise Unsound("block is cut")
    record = Record(at, fields, source.read(start, n))
    ended = source.read(start + n, 4) == b"\r\n\r\n"
    _check(record, ended)
    record.end = start + n + 4 * ended
    return record


def _check(record: Record, ended: bool) -> None:
    """Digests of block and payload; without any, the record must end in two empty lines."""
    kind = record.fields.get("warc-type", "")
    is_http = record.fields.get("content-type", "").startswith("application/http")
    record.payload = record.block.partition(b"\r\n\r\n")[2] if is_http else record.block
    record.digest = base64.b32encode(hashlib.sha1(record.payload).digest()).decode()
    given = record.fields.get("warc-payload-digest", "")
    checked = False
    if given.startswith("sha1:") and kind != "revisit":
        if given[5:].upper() != record.digest:
            raise Unsound("payload digest differs")
        checked = True
    block = record.fields.get("warc-block-digest", "")
    if block.startswith("sha1:"):
        if block[5:].upper() != base64.b32encode(hashlib.sha1(record.block).digest()).decode():
            raise Unsound("block digest differs")
        checked = True
    if not checked and not ended:
        raise Unsound("record does not end")


def _inflate(source: Held | Opened, at: int) -> tuple[bytes, int]:
    """Content and end of the member at ``at``."""
    engine, out, where, size = zlib.decompressobj(31), [], at, 0
    step = _FIRST_PIECE  # most members are small; of a large one more is read each time
    try:
        while not engine.eof:
            piece = source.read(where, step)
            step = min(2 * step, _PIECE)
            if not piece:
                raise Unsound("member is cut")
            part = engine.decompress(piece)
            size += len(part)
            if size > LONGEST_RECORD:
                raise Unsound("member is too long")
            out.append(part)
            where += len(piece)
    except zlib.error as problem:
        raise Unsound("member cannot be decompressed") from problem
    return b"".join(out), where - len(engine.unused_data)


READ = (
    "file string, start long, stop long, reason string, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read(spark: SparkSession, path: str, *, payload: bool = False) -> DataFrame:
    """Records and gaps of all files below ``path``; gaps are the rows with a ``reason``.

    ``payload_bytes`` and ``payload_digest`` of a response are those of the bytes read; a revisit has
    no payload, so it gives those its header states. ``payload`` is null unless asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole = files.filter(F.col("length") <= WHOLE_FILE_BYTES).select("path", "content")
    parts = files.filter(F.col("length") > WHOLE_FILE_BYTES).select("path", F.lit(None).cast("binary").alias("content"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()),
            ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                source = Held(content.as_py()) if content.is_valid else Opened(name.as_py())
                held, size = [], 0
                for found in salvage(source):
                    held.append({"file": name.as_py(), **_row(found, payload)})
                    size += len(held[-1].get("payload") or b"") + 200
                    if size > MEMBER_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return whole.unionByName(parts).mapInArrow(rows, READ)


def _row(found: Record | Gap, payload: bool) -> dict:
    if isinstance(found, Gap):
        return {"start": found.start, "stop": found.end, "reason": found.reason}
    fields = found.fields
    n, digest = len(found.payload), found.digest
    if fields.get("warc-type") == "revisit":
        stated = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", found.block)
        n = int(stated[1]) if stated else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return {
        "start": found.offset, "stop": found.end, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_bytes": n, "payload_digest": digest,
        "payload": found.payload if payload else None,
    }


def page_of(urn: Column) -> Column:
    """The page key in a record id of ``records``; null for pages that had none."""
    return F.regexp_extract(urn, f"^<{_ID}(-?[0-9]+)>$", 1).try_cast("long")
