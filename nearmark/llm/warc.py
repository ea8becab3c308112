"""WARC archives: a writer for Spark, and a reader that salvages damaged files.

Written are ``response`` records, and ``revisit`` records for payloads that an
earlier key has already; each is a gzip member of its own, or plain.  Tasks write
files of bounded size below a temporary folder, and only those of the attempts
that count are moved into place when the job is committed.

The reader streams each file and checks every record: its gzip member, version
line, headers, length, end mark and digests.  Where a check fails it looks for
the next place where a whole valid record begins, goes on there, and reports the
bytes between as a gap.  So it does within the plain bytes of a gzip member of
several records, also if the member breaks off.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from nearmark.llm.common import column
from nearmark.session import scratch_path

VERSION = b"WARC/1.1"
# A file is closed once it has this many bytes.
FILE_BYTES = 32 << 20
# Archives read by a task, once there are more than enough tasks.
TASK_BYTES = 256 << 20
# Payloads of fewer bytes are always written out.
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20
# Compressed bytes unpacked at once, and plain bytes of a member that stay in memory.
PACKED_BYTES, SPOOL_BYTES = 1 << 16, 1 << 26
GZIP = b"\x1f\x8b\x08"
HTTP_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
KEY_PREFIX = "urn:page:"


def record(key: str | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None, is_revisit: bool) -> bytes:
    """One record, plain.  A revisit has no payload, but its size and digest."""
    # Control characters and white space would end a header line or a name.
    uri = quote(url or "about:blank", safe="".join(map(chr, range(33, 127))))
    block = HTTP_OK % size + (b"" if is_revisit else payload or b"")
    lines = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{KEY_PREFIX}{'' if key is None else key}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        lines[4:4] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{KEY_PREFIX}{'' if refers_to is None else refers_to}>"),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def filesystem(path: str):
    """A file system and the path in it, for any scheme that Arrow knows."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, compress: bool, limit: int):
        self.path, self.compress, self.limit = path.rstrip("/"), compress, limit
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, folder = filesystem(self.temporary)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for row in iterator:
            data = record(row["key"], row["url"], row["payload"], row["digest"], row["size"], row["refers_to"], row["is_revisit"])
            if self.compress:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(data) + packer.flush()
            if out is None:
                files.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}")
                out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
            out.write(data)
            size += len(data)
            if size >= self.limit:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, folder = filesystem(self.path)
        temporary = filesystem(self.temporary)[1]
        for message in messages:
            for name in message.files if message else ():
                fs.move(f"{temporary}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, folder = filesystem(self.temporary)
        if fs.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(folder)


class WarcSink(DataSource):
    """``df.write.format("warc").save(path)``; options ``compress`` and ``limit``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "key string, url string, payload binary, digest string, size bigint, refers_to string, is_revisit boolean"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compress", "true") == "true", int(self.options.get("limit", FILE_BYTES)))


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows as they are written.

    Of rows whose payloads are equal and of ``least`` bytes or more, that with
    the least key is the response; the others revisit it and bring no payload
    along.  If several rows have that key, all are responses.  A null key comes
    after all others, and is a response only if no row of the group has a key.
    """
    body = F.coalesce(column(pages, payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(column(pages, key).alias("key"), column(pages, url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256))
    # Counted before the shuffle; only payloads that repeat are listed.
    listed = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    listed = listed.where("n > 1").select("digest", "first")
    out = rows.join(listed, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    out = out.withColumn("is_revisit", revisit)
    return out.select(
        F.col("key").cast("string").alias("key"), "url", F.when(~F.col("is_revisit"), F.col("payload")).alias("payload"), "digest", "size",
        F.when(F.col("is_revisit"), F.col("first").cast("string")).alias("refers_to"), "is_revisit",
    )


def write_warc(pages: DataFrame, path: str, compress: bool = True, limit: int = FILE_BYTES, **columns) -> None:
    """Write a record of each row below ``path``, a folder that executors share.

    Null payloads are empty.  Repeated rows are written each; an empty table
    writes no file.  Columns other than key, url and payload are ignored.
    """
    pages.sparkSession.dataSource.register(WarcSink)
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    planned(pages, **columns).write.format("warc").option("compress", str(compress).lower()).option("limit", limit).mode("append").save(path)


class Damaged(Exception):
    """Why the bytes at a place are no valid record."""


class Bytes:
    """Random access to a file, or to bytes, a part in memory at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""
        # Where the last search for a pattern began and what it found.
        self.sought: dict[bytes, tuple[int, int]] = {}

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.base or at + n > self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, READ_BYTES))
        return self.held[at - self.base : at - self.base + n]

    def find(self, pattern: bytes, at: int) -> int:
        """The first place of ``pattern`` from ``at`` on, or -1; bytes between searches are not searched again."""
        begin, last = self.sought.get(pattern, (self.size, 0))
        if begin <= at and (at <= last or last < 0):
            return last
        self.sought[pattern] = (at, found := self._find(pattern, at))
        return found

    def _find(self, pattern: bytes, at: int) -> int:
        while at < self.size:
            part = self.read(at, READ_BYTES)
            if (found := part.find(pattern)) >= 0:
                return at + found
            at += max(1, len(part) - len(pattern) + 1)
        return -1


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def parse(source: Bytes, at: int) -> tuple[Record, int]:
    """The plain record that begins at ``at``, and where it ends."""
    if not re.match(rb"WARC/1\.[0-9]\r\n", source.read(at, len(VERSION) + 2)):
        raise Damaged("no version line")
    end = source.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    for line in source.read(at, end - at).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit() and headers.get("warc-type") and headers.get("warc-record-id")):
        raise Damaged("a header is missing")
    start = end + 4
    stop = start + int(length)
    if stop > source.size:
        raise Damaged("record is cut off")
    block = source.read(start, int(length))
    if len(block) != int(length) or source.read(stop, 4) != b"\r\n\r\n":
        raise Damaged("no end mark")
    checked(headers.get("warc-block-digest"), block, "block")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] != "revisit":
        checked(headers.get("warc-payload-digest"), payload, "payload")
    return Record(headers, payload), stop + 4


def checked(digest: str | None, data: bytes, what: str) -> None:
    """Digests of SHA-256 in hexadecimal digits are checked, others cannot be."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() == "sha256" and re.fullmatch(r"[0-9a-fA-F]{64}", value) and hashlib.sha256(data).hexdigest() != value.lower():
        raise Damaged(f"{what} digest differs")


def unpacked(source: Bytes, at: int) -> tuple[Bytes, int, str | None]:
    """What the gzip member at ``at`` holds, where it ends, and why it breaks off if it does.

    What comes before a cut or a wrong byte is kept.  Much goes to a temporary file.
    """
    packer, place, step, size = zlib.decompressobj(31), at, PACKED_BYTES, 0
    out, fault = tempfile.SpooledTemporaryFile(SPOOL_BYTES), None
    while not packer.eof:
        part = source.read(place, step)
        if not part:
            fault = "member is cut off"
            break
        before = packer.copy()
        try:
            data = packer.decompress(part)
        except zlib.error as e:
            if len(part) == 1:
                fault = f"member: {str(e)[:60]}"
                break
            # Nearer to the wrong byte.
            packer, step = before, len(part) // 2
            continue
        out.write(data)
        size += len(data)
        place += len(part)
    return Bytes(out, size), place - len(packer.unused_data), fault


Piece = tuple[int, int, Record | None, str | None]


def inside(source: Bytes, at: int) -> tuple[Iterator[tuple[Record | None, str | None]], int | None]:
    """Records and gaps of the gzip member at ``at``, one record at least if it has bytes, and where it ends if it does."""
    plain, end, fault = unpacked(source, at)
    rest, first = pieces(plain, packed=False), []
    for piece in rest:
        first.append(piece)
        if piece[2]:
            break
    if fault and not (first and first[-1][2]):
        raise Damaged(fault)
    if first and not first[-1][2]:
        raise Damaged(first[0][3])

    def items() -> Iterator[tuple[Record | None, str | None]]:
        for b, e, one, why in itertools.chain(first, rest):
            yield one, why and f"bytes {b} to {e} of the member's plain bytes: {why}"
        if fault:
            yield None, fault

    return items(), None if fault else end


def opened(source: Bytes, at: int, packed: bool) -> tuple[Iterable[tuple[Record | None, str | None]], int | None]:
    if packed and source.read(at, 3) == GZIP:
        return inside(source, at)
    one, end = parse(source, at)
    return [(one, None)], end


def following(source: Bytes, at: int, packed: bool) -> int:
    """The next place from ``at`` on where something valid begins."""
    nexts = {p: source.find(p, at) for p in ((GZIP, b"WARC/1.") if packed else (b"WARC/1.",))}
    while any(v >= 0 for v in nexts.values()):
        pattern = min((p for p, v in nexts.items() if v >= 0), key=lambda p: nexts[p])
        place = nexts[pattern]
        try:
            opened(source, place, packed)
            return place
        except Damaged:
            nexts[pattern] = source.find(pattern, place + 1)
    return source.size


def pieces(source: Bytes, packed: bool = True) -> Iterator[Piece]:
    """(begin, end, record, None) of what is valid, (begin, end, None, reason) of gaps.

    Those inside a gzip member have its begin and end.  One that breaks off ends
    where the next valid one begins.
    """
    at = 0
    while at < source.size:
        try:
            found, end = opened(source, at, packed)
        except Damaged as e:
            begin, at = at, following(source, at + 1, packed)
            yield begin, at, None, str(e)
            continue
        if end is None:
            end = following(source, at + 1, packed)
        empty = True
        for one, why in found:
            empty = False
            yield at, end, one, why
        if empty:
            yield at, end, None, None
        at = end


def salvage(source: Bytes) -> Iterator[tuple[int, int, list[Record], str | None]]:
    """(begin, end, records, reasons for gaps or None) of each record, gzip member and gap."""
    for (begin, end), same in itertools.groupby(pieces(source), key=lambda p: p[:2]):
        held = list(same)
        yield begin, end, [p[2] for p in held if p[2]], "; ".join(p[3] for p in held if p[3]) or None


FIELDS = "file string, begin bigint, end bigint, headers map<string,string>, payload binary, damage string"


def read_warc(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Records and gaps of all files below ``path``.

    Columns: ``file``, ``begin`` and ``end`` (bytes in the file), ``headers`` (names
    in lower case) and ``payload`` of a record, ``damage`` (why) of a gap, whose
    other columns are null; what a gzip member holds has the member's place.  Files are listed by Spark and each is streamed by
    one task; a record must fit into memory.  No file gives an empty table.  With
    ``whole`` a gap is an error.
    """
    fs, folder = filesystem(path)
    files = spark.createDataFrame([], "path string, length bigint")
    if any(i.is_file for i in fs.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True))):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    # A number that is given is not merged: names are small, what they name is not.
    tasks = max(1, min(seen["n"], max((seen["bytes"] or 0) // TASK_BYTES, 4 * spark.sparkContext.defaultParallelism)))
    kind = pa.map_(pa.string(), pa.string())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                own, place = filesystem(name)
                with own.open_input_file(place) as file:
                    rows, size = [], 0
                    for begin, end, one, damage in pieces(Bytes(file, file.size())):
                        if damage and whole:
                            raise ValueError(f"{name}: bytes {begin} to {end}: {damage}")
                        rows += [(name, begin, end, list(one.headers.items()), one.payload, None)] if one else []
                        rows += [(name, begin, end, None, None, damage)] if damage else []
                        size += len(one.payload) if one else 0
                        if size > 1 << 22 or len(rows) > 1000:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), kind, pa.binary(), pa.string()]
        names = ["file", "begin", "end", "headers", "payload", "damage"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return files.select("path").repartition(tasks).mapInArrow(read, FIELDS)


def key_of(header: Column) -> Column:
    """The key in a record's name; an empty one is null."""
    return F.nullif(F.regexp_extract(header, f"^<{KEY_PREFIX}(.*)>$", 1), F.lit(""))


def archived(found: DataFrame, kind: str) -> DataFrame:
    """The records' keys and payloads' sizes and digests, as read back from archives."""
    header = lambda name: F.col("headers")[name]
    records = found.where("damage is null")
    revisit = header("warc-type") == "revisit"
    size = F.when(revisit, header("x-payload-length").cast("bigint")).otherwise(F.octet_length("payload").cast("bigint"))
    digest = F.when(revisit, F.regexp_replace(header("warc-payload-digest"), "^sha256:", "")).otherwise(F.sha2("payload", 256))
    return records.select(
        key_of(header("warc-record-id")).cast(kind).alias("key"), size.alias("payload_bytes"), digest.alias("payload_digest"),
        header("warc-type").alias("record_type"), key_of(header("warc-refers-to")).cast(kind).alias("refers_to"),
    )


def archive_report(spark, folder: str) -> DataFrame:
    """``op3``: every page written to archives and read back; one that cannot be read is an error."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = scratch_path(spark, "archives")
    write_warc(pages, path)
    return archived(read_warc(spark, path, whole=True), pages.schema["page_id"].dataType.simpleString()).withColumnRenamed("key", "page_id")


ARCHIVE_SQL = """
WITH rows_ AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM rows_
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM firsts
"""
