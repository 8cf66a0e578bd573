"""WARC archives as a Spark data source (format name ``warc``).

Writing: every row is one gzip member, so archives stay splittable by tools
that know WARC.  The member's extra field ``sl`` holds its compressed and plain
length, as archive tools write it, so a reader steps over a record without
inflating it.

Reading: the planner lists the archives and deals them, largest first, into
partitions by size; an archive larger than a partition is read in byte ranges, each
beginning at the first member header after its start.  A task inflates only as much
of a member as its headers need, applies the pushed record-type and header
predicates, and inflates the payload of matching records alone; the rest is skipped
by length.  Archives that others wrote are read as well: gzip members without
stated lengths (inflated in one run, which one task does), plain ``.warc`` files, and
records whose block is no HTTP message, whose payload is then the whole block.

A path is a folder that this source wrote (its committed files), any other folder
(its ``.warc`` and ``.warc.gz`` files) or one archive.

Options: ``payload`` = ``full`` (default), ``verify`` (payload checked against
its digest, then dropped) or ``none``; ``partition_bytes`` is the target size.

Rows: record_id, record_type, uri, refers_to, payload_digest, payload_bytes,
payload (null for revisits, which carry headers alone).  All but the payload
may be null.  Text that a header line cannot carry is percent-encoded under a
starred header name.

Edge cases: a null html is an empty payload; null ids and urls leave their headers
out; repeated rows are records each; a payload of any length is held whole while
its record is read or written, never more than one; other columns of the pages are
ignored; an empty table gives a folder without archives and reads as no rows;
a record that ends early or does not begin like one is an error that names the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from tidemark.llm import store

SCHEMA = (
    "record_id string, record_type string, uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "uri": "WARC-Target-URI",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"  # no clock is read, so a repeated task writes the same bytes
HEAD_BYTES = 4096
FIXED = b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<H", 20) + b"sl" + struct.pack("<H", 16)  # begins a member
BLANK = re.compile(rb"\r?\n\r?\n")
SHA1 = re.compile("[A-Z2-7]{32}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def line(name: str, value: str | None) -> str:
    if value is None:
        return ""
    if value != value.strip() or not value or any(ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 or c in "  " for c in value):
        return f"{name}-Star: {urllib.parse.quote(value, safe='')}.\r\n"
    return f"{name}: {value}\r\n"


def record(row: dict) -> bytes:
    """One record as a gzip member with its lengths in the extra field."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    size = row["payload_bytes"] if revisit and row["payload_bytes"] is not None else len(payload)
    digest = row["payload_digest"] or sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = "WARC/1.1\r\n" + "".join(
        line(HEADERS[c], f"sha1:{digest}" if c == "payload_digest" else row[c]) for c in HEADERS
    )
    head += f"WARC-Date: {EPOCH}\r\n" + (f"WARC-Profile: {PROFILE}\r\n" if revisit else "")
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    plain = head.encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    lengths = struct.pack("<QQ", len(body), len(plain))
    return FIXED + lengths + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class Written(WriterCommitMessage):
    def __init__(self, name: str, records: int):
        self.name, self.records = name, records


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer(DataSourceArrowWriter):
    """A file per task under a name of its own attempt; committed attempts are listed in `_files`."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        name, records = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    out.write(record(batch.slice(i, 1).to_pylist()[0]))
                records += batch.num_rows
        return Written(name, records)

    def commit(self, messages) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_files", compression=None) as out:
            out.write("".join(f"{m.name}\n" for m in messages if m is not None).encode())

    def abort(self, messages) -> None:
        files, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.name}")


class Archives(InputPartition):
    """(name, first byte, byte after the last) of the pieces of archives that one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


class Record:
    """A record's fields, and its block only as far as it is asked for."""

    def __init__(self, head: bytes, rest: bytes):
        lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()
        if not lines or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.rest, self.fields = rest, {}
        for x in lines[1:]:
            name, _, value = x.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name.endswith("-star"):
                name, value = name.removesuffix("-star"), urllib.parse.unquote(value[:-1])
            self.fields[name] = value
        self.length = int(self.fields.get("content-length", 0))

    def _more(self) -> bool:
        """Puts more of the block, and maybe what follows it, behind `rest`; False at its end."""
        raise NotImplementedError

    def http(self) -> tuple[int, int | None]:
        """(where the payload begins in the block, its length; of a revisit the stated one)."""
        if "application/http" not in self.fields.get("content-type", "").lower():
            return 0, self.length
        while not (end := BLANK.search(self.rest)) and len(self.rest) < self.length and self._more():
            pass
        begin = min(end.end(), self.length) if end else self.length
        if self.fields.get("warc-type") != "revisit":
            return begin, self.length - begin
        stated = re.search(rb"(?mi)^content-length:\s*(\d+)", self.rest[:begin])
        return begin, int(stated[1]) if stated else None

    def payload(self) -> bytes:
        begin, _ = self.http()
        while len(self.rest) < self.length and self._more():
            pass
        if len(self.rest) < self.length:
            raise EOFError("archive ends inside a record")
        return self.rest[begin : self.length]


class Member(Record):
    """A gzip member that states its lengths."""

    def __init__(self, stream, fixed: bytes):
        if fixed[:16] != FIXED:
            raise ValueError("not a record member with its lengths in the extra field")
        self.packed, self.plain = struct.unpack("<QQ", fixed[16:32])
        self.stream, self.read, self.inflater = stream, 0, zlib.decompressobj(-15)
        self.rest = b""
        while b"\r\n\r\n" not in self.rest and self._more():
            pass
        head, _, rest = self.rest.partition(b"\r\n\r\n")
        super().__init__(head, rest)

    def _more(self) -> bool:
        if self.read == self.packed:
            return False
        chunk = self.stream.read(min(max(HEAD_BYTES, len(self.rest)), self.packed - self.read))
        if not chunk:
            raise EOFError("archive ends inside a record")
        self.read += len(chunk)
        self.rest += self.inflater.decompress(chunk)
        return True

    def skip(self) -> None:
        self.stream.seek(self.packed - self.read + 8, 1)


class Loose(Record):
    """A record of a plain stream of records."""

    def __init__(self, stream, first: bytes):
        self.stream, head = stream, first
        while (x := stream.readline()) not in (b"\r\n", b"\n", b""):
            head += x
        super().__init__(head, b"")

    def _more(self) -> bool:
        chunk = self.stream.read(min(max(HEAD_BYTES, len(self.rest)), self.length - len(self.rest)))
        self.rest += chunk
        return bool(chunk)

    def skip(self) -> None:
        left = self.length - len(self.rest)
        while left > 0 and (chunk := self.stream.read(min(left, 1 << 20))):
            left -= len(chunk)


def members(source, start: int, end: int) -> Iterator[Record]:
    """The records that begin in [start, end) of an open archive."""
    head = source.read(16)
    if head[:16] == FIXED:
        stream = io.BufferedReader(source, 1 << 20)
        at = _next_member(stream, start)
        while at is not None and at < end:
            stream.seek(at)
            fixed = stream.read(32)
            if not fixed:
                return
            if fixed[:16] != FIXED:  # from here on somebody else's
                stream.seek(at)
                yield from _loose(gzip.GzipFile(fileobj=stream))
                return
            member = Member(stream, fixed)
            yield member
            at += 32 + member.packed + 8
    elif start == 0:
        source.seek(0)
        stream = io.BufferedReader(source, 1 << 20)
        yield from _loose(gzip.GzipFile(fileobj=stream) if head[:2] == b"\x1f\x8b" else stream)


def _loose(stream) -> Iterator[Record]:
    while first := stream.readline():
        if first.strip():
            found = Loose(stream, first)
            yield found
            found.skip()


def _next_member(stream, start: int) -> int | None:
    """Where the first member at or after `start` begins: its fixed bytes, and a member or the end behind it."""
    if start == 0:
        return 0
    stream.seek(start)
    held, base = b"", start
    while True:
        chunk = stream.read(1 << 20)
        held += chunk
        at = held.find(FIXED)
        while at >= 0:
            place = base + at
            stream.seek(place + 16)
            lengths = stream.read(16)
            if len(lengths) == 16:
                stream.seek(place + 32 + struct.unpack("<Q", lengths[:8])[0] + 8)
                behind = stream.read(16)
                if not behind or behind[:3] == b"\x1f\x8b\x08":
                    return place
            at = held.find(FIXED, at + 1)
        if not chunk:
            return None
        base, held = base + len(held) - min(len(held), 15), held[-15:]
        stream.seek(base + len(held))


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: str, partition_bytes: int):
        self.path, self.mode, self.partition_bytes = path, payload, partition_bytes
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Equality, membership and presence of a header; others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wanted.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, frozenset(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, frozenset()))
            else:
                yield f

    def partitions(self):
        files, root = filesystem(self.path)
        sized = sorted(archives(files, root), reverse=True)
        dealt: list[list[tuple[str, int, int]]] = []
        weight = 0
        for size, name in sized:
            if size > 2 * self.partition_bytes:
                pieces = -(-size // self.partition_bytes)
                edge = [size * i // pieces for i in range(pieces + 1)]
                dealt += [[(name, a, b)] for a, b in zip(edge, edge[1:])]
                weight = self.partition_bytes
                continue
            if not dealt or weight + size > self.partition_bytes:
                dealt.append([])
                weight = 0
            dealt[-1].append((name, 0, size))
            weight += size
        return [Archives(x) for x in dealt] or [Archives([])]

    def _values(self, member: Record) -> dict | None:
        row = {c: member.fields.get(h.lower()) for c, h in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        for column, values in self.wanted:
            if row[column] is None or values and row[column] not in values:
                return None
        row["payload"] = None
        row["payload_bytes"] = member.http()[1]
        if row["record_type"] != "revisit" and self.mode != "none":
            payload = member.payload()
            if self.mode == "full":
                row["payload"] = payload
            elif SHA1.fullmatch(row["payload_digest"] or "") and sha1_base32(payload) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not match its digest")
        return row

    def read(self, partition: Archives):
        files, _ = filesystem(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        held, weight = [], 0
        for name, start, end in partition.pieces:
            with files.open_input_file(name) as source:
                try:
                    for member in members(source, start, end):
                        if (row := self._values(member)) is None:
                            continue
                        held.append(row)
                        weight += 200 + len(row["payload"] or b"")
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, weight = [], 0
                except (EOFError, ValueError, zlib.error) as error:
                    raise ValueError(f"{name}: {error}") from error
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


def archives(files, root: str) -> list[tuple[int, str]]:
    """(size, path) of every archive of a path."""
    from pyarrow import fs

    kind = files.get_file_info(root)
    if kind.type == fs.FileType.File:
        return [(kind.size, root)]
    if kind.type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    if files.get_file_info(f"{root}/_files").type == fs.FileType.File:
        listed = files.open_input_stream(f"{root}/_files", compression=None).read().decode().split()
        return [(files.get_file_info(f"{root}/{n}").size, f"{root}/{n}") for n in listed]
    found = files.get_file_info(fs.FileSelector(root))
    return [(f.size, f.path) for f in found if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = self.options
        return Reader(options["path"], options.get("payload", "full"), int(options.get("partition_bytes", 64 << 20)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One record per (page_id, url, html) row: of equal payloads of at least `least_bytes` the one with
    the largest page_id is the response and others revisit it.

    Digests are counted before anything is joined, and only rows that revisit
    meet the pages again, by id and digest, so a payload that a third of all
    pages share crosses the network as one aggregate and narrow rows.  A null
    html is an empty payload; rows that repeat the winning id are responses too,
    as are rows without id.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    ids = rows.where((F.col("page_id").isNotNull()) & (F.length("payload") >= least_bytes)).select("page_id", "digest")
    winners = ids.groupBy("digest").agg(F.max("page_id").alias("winner"), F.min("page_id").alias("low")).where("low < winner")
    again = ids.join(winners, "digest").where("page_id < winner").select("page_id", "digest", "winner").distinct()
    full = rows.join(again, ["page_id", "digest"], "left")
    revisit = F.col("winner").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return full.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("uri"),
        urn(F.col("winner")).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(spark: SparkSession, pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write the pages' records under `path` (a URI that every executor reaches)."""
    register(spark)

    def base32(batches):
        for batch in batches:
            digests = [base64.b32encode(bytes.fromhex(d)).decode() for d in batch.column("payload_digest").to_pylist()]
            at = batch.schema.get_field_index("payload_digest")
            yield batch.set_column(at, "payload_digest", pa.array(digests, pa.string()))

    rows = records(pages, least_bytes)
    with store.shuffles_freed(spark):
        rows.mapInArrow(base32, rows.schema).write.format("warc").mode("append").save(path)


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page; payloads are read and checked against their digests, then dropped."""
    register(spark)
    rows = spark.read.format("warc").option("payload", "verify").load(path)
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return rows.select(
        number("record_id").alias("page_id"), F.col("uri").alias("url"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )
