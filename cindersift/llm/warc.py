"""WARC archives: a writer, and a salvage reader that gets what can be had from damaged ones.

An archive is read record by record, each a gzip member of its own or plain. A record counts if its version line,
headers, length, closing blank lines, gzip checksum and (where given) block digest are right. After a failed check
the reader searches for the next gzip magic or version line from which a whole record can be read, goes on from
there, and logs the bytes between as a quarantined gap with the reason. What could be unpacked of a damaged member is
searched in the same way for version lines, and so is a sound member in which a record is damaged.

Archives are rows (archive, content), such as ``spark.read.format("binaryFile")`` gives, which have to fit a task's
memory; so the writer begins a new one after about ``ARCHIVE_BYTES``. :func:`read_files` reads files of any size, of
which a task has a window of ``WINDOW`` bytes and the record at hand.

Defined results: an empty or null archive has no rows; one without any valid record is one gap. Records of one member
share its offset and length; one out of a damaged member has the member's offset and length 0, as its bytes count in
the gap; a gap inside a sound member has length 0 too. A record of 2 GiB and more fits no cell, so it is a gap. Written
records with a null id or url lack that header and come back with null; a null text is written as an empty block; ids
may be of any type. Repeated rows are records of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches
from . import columnar as C

ARCHIVE_BYTES = 8 << 20
#: Of so many ids the query damages three: it tears a plain record, flips a sign of a member, and cuts one off.
DAMAGED_EVERY = 50
TORN_AT, FLIPPED_AT, CUT_AT = 7, 19, 31
WINDOW = 8 << 20
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_NAME, _CONTROL = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*"), re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_LIMIT, _PIECE = (1 << 31) - 1, 1 << 14
_DATE = "2024-01-01T00:00:00Z"


def _escaped(text: str) -> str:
    return re.sub(r"[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: object, url: str | None, block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Date: {_DATE}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{_escaped(str(page_id))}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + _escaped(url))
    lines += ["Content-Type: text/html", f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def torn(page_id: object, url: str | None, block: bytes) -> bytes:
    """What a writer leaves that stops in the middle of a plain record."""
    return record(page_id, url, block)[: -4 - (len(block) + 1) // 2]


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def stored(data: bytes) -> bytes:
    """A member that isn't compressed, whose length is known by that of the data."""
    blocks = [data[a : a + 65535] for a in range(0, len(data), 65535)] or [b""]
    body = b"".join(struct.pack("<BHH", k == len(blocks) - 1, len(b), 65535 - len(b)) + b for k, b in enumerate(blocks))
    return b"\x1f\x8b\x08" + bytes(6) + b"\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) % (1 << 32))


def flipped(page_id: object, url: str | None, block: bytes) -> bytes:
    """A member with a wrong sign in its block's digest, so that neither its checksum nor that is right."""
    made = stored(record(page_id, url, block))
    at = made.index(b"Block-Digest: sha1:") + 19
    return made[:at] + b"!" + made[at + 1 :]


def cut(page_id: object, url: str | None, block: bytes) -> bytes:
    """A member whose end is missing."""
    return stored(record(page_id, url, block))[: -12 - (len(block) + 1) // 2]


DAMAGES = {"torn": torn, "flipped": flipped, "cut": cut}


def _write(limit: int, damage: dict[str, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, first = 0, ""

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first], pa.string()), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i, url, text in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "text"))):
                block = (text or "").encode("utf-8", "surrogatepass")
                if not held:
                    first = f"pages-{i}.warc.gz"
                number = i if isinstance(i, int) else zlib.crc32(str(i).encode())
                for how, (every, which) in damage.items():
                    if i is not None and number % every == which:
                        held.append(DAMAGES[how](i, url, block))
                        size += len(held[-1])
                held.append(member(record(i, url, block)))
                size += len(held[-1])
                if size >= limit:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, damage: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(archive, content). With ``damage``, of the records whose id (or its CRC-32) is r modulo n there is before each one a
    damaged one: of the kinds of DAMAGES, each with its (n, r)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(C.tidy(_write(archive_bytes, damage or {})), "archive string, content binary")


class Window:
    """A file as if it were its bytes, of which a window is in memory."""

    def __init__(self, source: pa.NativeFile, size: int, width: int = WINDOW):
        self.source, self.size, self.width, self.base, self.data = source, size, width, 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        if b - a > self.width:
            return self.source.read_at(b - a, a)
        if a < self.base or b > self.base + len(self.data):
            self.base, self.data = a, self.source.read_at(min(self.width, self.size - a), a)
        return self.data[a - self.base : max(a, b) - self.base]

    def startswith(self, prefix: bytes | tuple[bytes, ...], at: int) -> bool:
        return self[at : at + 16].startswith(prefix)

    def find(self, what: bytes, at: int) -> int:
        while at < self.size:
            part = self[at : at + self.width]
            if (k := part.find(what)) >= 0:
                return at + k
            at += max(1, len(part) - len(what) + 1)
        return -1


def _ahead(data: bytes | Window, at: int) -> int:
    """Where the next record or member may begin."""
    if isinstance(data, bytes):
        found = _START.search(data, at)
        return found.start() if found else len(data)
    while at < len(data):
        part = data[at : at + data.width]
        if found := _START.search(part):
            return at + found.start()
        at += max(1, len(part) - 9)
    return len(data)


def parse(data: bytes | Window, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the plain record at a place, or what is wrong with it."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        return "no version line"
    headers, place = {}, at + 10
    while (end := data.find(b"\r\n", place)) != place:
        if end < 0:
            return "headers without end"
        name, colon, value = data[place:end].partition(b":")
        # what was cut off runs into the next record: its bytes or its headers would be taken for this one's
        if not colon or not _NAME.fullmatch(name) or _CONTROL.search(value):
            return "bad header line"
        known = name.strip().lower().decode()
        if known in headers and known != "warc-concurrent-to":
            return "repeated header"
        headers[known] = value.strip().decode("utf-8", "replace")
        place = end + 2
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no length"
    first, last = end + 2, end + 2 + int(length)
    if int(length) > _LIMIT:
        return "too large for a cell"
    if last + 4 > len(data):
        return "cut short"
    if data[last : last + 4] != b"\r\n\r\n":
        return "no blank lines at the end"
    block = data[first:last]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest.upper() not in (base64.b32encode(hashlib.sha1(block).digest()).decode(), hashlib.sha1(block).hexdigest().upper()):
        return "wrong digest"
    return headers, block, last + 4


def unpack(data: bytes | Window, at: int) -> tuple[bytes, int | None, str]:
    """What can be unpacked of the member at a place, where it ends (None if it is damaged), and what is wrong with it."""
    z = zlib.decompressobj(31)
    parts, size, upto, wrong = [], 0, at, "gzip: cut short"
    try:
        # by pieces: what follows a member must not be copied for each
        while not z.eof and upto < len(data) and size <= _LIMIT:
            parts.append(z.decompress(data[upto : upto + _PIECE]))
            upto += _PIECE
            size += len(parts[-1])
    except zlib.error as error:
        wrong = f"gzip: {error}"
    if size > _LIMIT:
        wrong = "gzip: too large for a cell"
    return b"".join(parts), min(upto, len(data)) - len(z.unused_data) if z.eof else None, wrong


def inside(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes | None, str | None]]:
    """(place, length, headers, block, reason) of each record, and of each gap, in what a member held."""
    at, gap, reason = 0, None, None
    while at < len(plain):
        one = parse(plain, at)
        if isinstance(one, str):
            if gap is None:
                gap, reason = at, one
            at = plain.find(b"WARC/1.", at + 1)
            at = len(plain) if at < 0 else at
            continue
        if gap is not None:
            yield gap, at - gap, {}, None, reason
            gap = None
        yield at, one[2] - at, one[0], one[1], None
        at = one[2]
    if gap is not None:
        yield gap, len(plain) - gap, {}, None, reason


def salvage(data: bytes | Window) -> Iterator[tuple[str, int, int, dict[str, str], bytes | None, str | None]]:
    """(kind, offset, length, headers, block, reason) of each record, and of each gap."""
    at, gap, reason = 0, None, None
    had: list[tuple[dict[str, str], bytes | None]] = []  # out of damaged members of the gap
    while at < len(data):
        found: list[tuple] = []
        if data.startswith(b"\x1f\x8b\x08", at):
            plain, end, wrong = unpack(data, at)
            own = list(inside(plain))
            if end is None or not any(x[3] is not None for x in own):
                wrong = wrong if end is None else own[0][4] if own else "empty member"
                for _, _, headers, block, _ in own:
                    if block is not None:
                        had.append((headers, block))
                        yield "record", at, 0, headers, block, None
                end = None
            else:
                found = [("record", at, end - at, h, b, None) if b is not None else ("gap", at, 0, {}, None, f"{n} bytes from {k} on inside a member: {why}") for k, n, h, b, why in own]
        else:
            one = parse(data, at)
            end, wrong = (None, one) if isinstance(one, str) else (one[2], "")
            # what isn't compressed in a damaged member was had from there
            if end is not None and gap is not None and (one[0], one[1]) in had:
                end, wrong = None, reason
            elif end is not None:
                found = [("record", at, end - at, one[0], one[1], None)]
        if end is None:
            if gap is None:
                gap, reason = at, wrong
            at = _ahead(data, at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, {}, None, reason
            gap, had = None, []
        yield from found
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, {}, None, reason


_SALVAGED = "archive string, kind string, offset bigint, length bigint, type string, record_id string, url string, date string, block binary, reason string"


def _rows(archive: str, data: bytes | Window) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SALVAGED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows, size = [], 0
    for kind, offset, length, head, block, reason in salvage(data):
        rows.append((archive, kind, offset, length, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), block, reason))
        size += len(block or b"")
        if size > 1 << 22:
            yield made(rows)
            rows, size = [], 0
    if rows:
        yield made(rows)


def _salvage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
            yield from _rows(archive, content.as_py() or b"")


def _salvage_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as source:
                yield from _rows(uri, Window(source, source.size()))


def read_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """The same as :func:`read_archives` for files, a task for each, whatever their size; URIs that all executors can read."""
    small_batches(spark)
    return spark.createDataFrame([(u,) for u in uris], "archive string").repartition(max(1, len(uris))).mapInArrow(C.tidy(_salvage_files), _SALVAGED)


def read_archives(archives: DataFrame, archive_col: str = "archive", content_col: str = "content") -> DataFrame:
    """A row for each record and each gap: archive, kind, offset, length, type, record_id, url, date, block, reason."""
    small_batches(archives.sparkSession)
    return archives.select(F.col(archive_col).cast("string").alias("archive"), F.col(content_col).alias("content")).mapInArrow(C.tidy(_salvage), _SALVAGED)


def pages_of(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(kind, page_id, url, n_bytes, digest) of what was found: pages with the bytes and MD5 of their text, and gaps with their bytes."""

    def plain(text: F.Column) -> F.Column:
        return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))

    page = F.regexp_extract("record_id", "(?s)^<urn:page:(.*)>$", 1)
    return found.select(
        "kind", F.when(page != "", plain(page).try_cast(id_type)).alias("page_id"), plain(F.col("url")).alias("url"),
        F.when(F.col("kind") == "gap", F.col("length")).otherwise(F.octet_length("block")).cast("bigint").alias("n_bytes"), F.md5("block").alias("digest"),
    )


def oracle() -> str:
    """DuckDB SQL for what is found in archives of ``pages`` with damaged records among them."""
    fixed = len(record(None, None, b"")) - 1 + len("WARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: \r\n")
    text = "coalesce(html, '')"
    whole = f"{fixed} + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(CAST(strlen({text}) AS VARCHAR)) + strlen({text})"
    half = f"(strlen({text}) + 1) // 2"
    member = f"18 + 5 * (({whole} + 65534) // 65535) + {whole}"

    def gap(size: str, which: int) -> str:
        return f"SELECT 'gap', NULL, NULL, CAST({size} AS BIGINT), NULL FROM pages WHERE page_id % {DAMAGED_EVERY} = {which}"

    return f"""
SELECT 'record' AS kind, page_id, url, CAST(strlen({text}) AS BIGINT) AS n_bytes, md5({text}) AS digest FROM pages
UNION ALL {gap(f"{whole} - 4 - {half}", TORN_AT)}
UNION ALL {gap(member, FLIPPED_AT)}
UNION ALL {gap(f"{member} - 12 - {half}", CUT_AT)}"""
