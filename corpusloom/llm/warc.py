"""WARC archives: a data source for reading and writing, and archives of pages
in which repeated payloads are revisits.

*Source.* ``register(spark)`` makes the format ``warc`` known. A read plans its
partitions from the files' sizes. For every record the headers are parsed first.
Predicates on ``HEADERS`` columns are pushed down to them as options of the read,
and a record that fails one, or whose payload nobody asked for, is passed over: in
plain files by its length, in files of one gzip member per record by the length
that the member's ``sl`` field states, so its payload is never inflated. Members
without that field, from other writers, are inflated and dropped piece by piece.
The schema given to the reader names the wanted columns; without ``payload`` no
payload is decoded. ``verify`` compares payloads with their digests all the same.
Predicates are options because a table keeps them for good: filters that Spark
itself pushes to a Python source stay with the table, so that a table read twice
under different filters gives wrong rows (``test_a_table_read_twice``).

*Writing.* A task writes under names of its own, some ``FILE_BYTES`` a file. The
commit names the files of the tasks that count in one small ``_committed`` file;
what a lost or repeated attempt leaves behind is named by none and never read.

*Pages.* A record's payload is the page's html in UTF-8. Of records with equal
payloads of at least ``least`` bytes the one with the smallest id is the
response, the others revisit it and hold the HTTP header only. Payloads are equal
if SHA-1, length and XXH64 are. A null html is an empty payload. Rows that share
id and payload are all responses if theirs is the smallest id, else revisits. A
null id comes last: it revisits the smallest id there is, and rows that have
none but null ids are all responses. A null url writes no target. An empty table
writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from corpusloom.operators.joins import lookup_join
from corpusloom.sources.staging import shared_folder

# executors get the classes below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_BYTES = 1 << 30
PARTITION_BYTES = 128 << 20
WINDOW = 1 << 18
HEAD = 1 << 12
LEVEL = 3
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
MANIFEST = "_committed-"

# columns that are header fields; fixed values of the format
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, content_type string, "
    "payload_digest string, payload_length bigint, file string, `offset` bigint, payload binary"
)
ARROW = {"payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


# ---- one record ----


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of each; a line that begins
    with a blank continues the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower() if colon and name.strip().lower() not in fields else None
        if last:
            fields[last] = value.strip()
    return fields


class Window:
    """Random reads of a file through one buffer."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.size = source, source.size()
        self.start, self.held = 0, b""

    def at(self, place: int, length: int) -> bytes:
        """Up to ``length`` bytes; fewer at the end of the file."""
        if place < self.start or place + length > self.start + len(self.held):
            self.source.seek(place)
            self.start, self.held = place, self.source.read(min(max(length, WINDOW), self.size - place))
        return self.held[place - self.start : place - self.start + length]


class Plain:
    """The bytes of a record that is not compressed."""

    def __init__(self, window: Window, place: int) -> None:
        self.window, self.place = window, place

    def upto(self, n: int) -> bytes:
        return self.window.at(self.place, n)

    def end(self, length: int) -> int:
        return self.place + length

    def check(self) -> None:
        """A plain record has no checksum of its own."""


class Member:
    """The bytes of a record that is a gzip member, inflated as far as asked."""

    def __init__(self, window: Window, place: int) -> None:
        self.window, self.place, self.fed = window, place, place
        self.inflater = zlib.decompressobj(31)
        self.out = bytearray()
        self.stated = self._stated()

    def _stated(self) -> int | None:
        """The member's length by its ``sl`` field."""
        head = self.window.at(self.place, 12)
        if len(head) < 12 or not head[3] & 4:
            return None
        extra = self.window.at(self.place + 12, struct.unpack_from("<H", head, 10)[0])
        while len(extra) >= 4:
            name, length = extra[:2], struct.unpack_from("<H", extra, 2)[0]
            if name == b"sl" and length == 8:
                return struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + length :]
        return None

    def _more(self, n: int) -> bytes:
        data = self.inflater.unconsumed_tail
        if not data:
            most = WINDOW if self.stated is None else min(WINDOW, self.place + self.stated - self.fed)
            data = self.window.at(self.fed, most)
            self.fed += len(data)
        out = self.inflater.decompress(data, n)
        if not (data or out or self.inflater.eof):
            raise ValueError(f"the gzip member at {self.place} is cut off")
        return out

    def upto(self, n: int) -> bytes:
        while len(self.out) < n and not self.inflater.eof:
            self.out += self._more(max(n - len(self.out), HEAD))
        return bytes(self.out[:n])

    def end(self, length: int) -> int:
        if self.stated is not None:
            return self.place + self.stated
        self.check()
        return self.fed - len(self.inflater.unused_data)

    def check(self) -> None:
        """Inflate to the end, where the member's checksum is."""
        while not self.inflater.eof:
            self._more(WINDOW)


class Record:
    """Headers of one record; its payload only when asked for."""

    def __init__(self, window: Window, place: int) -> None:
        self.place = place
        packed = window.at(place, 2) == b"\x1f\x8b"
        self.body = Member(window, place) if packed else Plain(window, place)
        self.start = self._behind(0)
        head = self.body.upto(self.start)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {place}")
        self.fields = _fields(head[: -len(END)])
        if not self.fields.get("content-length", "").isdigit():
            raise ValueError(f"the record at {place} has no length")
        self.length = int(self.fields["content-length"])

    def _behind(self, start: int, most: int | None = None) -> int:
        """The place behind the first blank line after ``start``."""
        size = start
        while True:
            size += HEAD
            piece = self.body.upto(size if most is None else min(size, most))
            found = piece.find(END, max(start, size - HEAD - len(END)))
            if found >= 0:
                return found + len(END)
            if len(piece) < size:
                raise ValueError(f"the record at {self.place} has no end of headers")

    def next(self) -> int:
        return self.body.end(self.start + self.length + len(END))

    def http(self) -> tuple[int, dict[str, str]]:
        """Start of the payload, and the fields of the HTTP header before it."""
        if not self.fields.get("content-type", "").replace(" ", "").startswith("application/http"):
            return self.start, {}
        behind = self._behind(self.start, self.start + self.length)
        return behind, _fields(self.body.upto(behind)[self.start : -len(END)])

    def payload_length(self) -> int | None:
        """Length of the whole payload, also where it is stored elsewhere."""
        behind, http = self.http()
        if self.fields.get("warc-type") == "revisit":
            stated = http.get("content-length", "")
            return int(stated) if stated.isdigit() else None
        return self.start + self.length - behind

    def payload(self) -> bytes | None:
        if self.fields.get("warc-type") == "revisit":
            return None
        behind, _ = self.http()
        whole = self.body.upto(self.start + self.length + len(END))
        if len(whole) < self.start + self.length:
            raise ValueError(f"the record at {self.place} is cut off")
        self.body.check()
        return whole[behind : self.start + self.length]

    def check(self) -> None:
        kind, _, digest = self.fields.get("warc-payload-digest", "").partition(":")
        payload = self.payload()
        if kind == "sha1" and payload is not None and base32(hashlib.sha1(payload).hexdigest()) != digest:
            raise ValueError(f"the record at {self.place} has another digest")


def _safe(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(row: dict) -> bytes:
    """A record of the columns that ``archive`` writes, uncompressed."""
    payload = row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_length']}\r\n\r\n"
    ).encode()
    block = http if row["record_type"] == "revisit" else http + payload
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", row["record_id"] or f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", row["payload_digest"]),
        ("WARC-Profile", REVISIT if row["record_type"] == "revisit" else None),
        ("WARC-Refers-To", row["refers_to"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_safe(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + END


def member_bytes(plain: bytes) -> bytes:
    """A gzip member that states its own length."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    packed = packer.compress(plain) + packer.flush()
    size = 24 + len(packed) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(plain) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


# ---- the data source ----


class Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        super().__init__(0)
        self.names = names


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


def committed(folder: str) -> list[tuple[str, int]]:
    """Names and sizes of a folder's archives: those that commits name, or all
    if there are no commits."""
    store, place = fs.FileSystem.from_uri(folder)
    found = {i.base_name: i.size for i in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if i.is_file}
    manifests = [name for name in found if name.startswith(MANIFEST)]
    names = [name for name in found if name.endswith((".warc", ".warc.gz"))]
    if manifests:
        names = []
        for manifest in manifests:
            with store.open_input_stream(f"{place}/{manifest}") as source:
                names += json.loads(source.read())
    return sorted((name, found[name]) for name in names)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folder = options["path"]
        self.parallelism = int(options.get("parallelism", "1"))
        self.verify = options.get("verify", "false").lower() == "true"
        self.columns = schema.fieldNames()
        self.any_of = {HEADERS[c]: set(v) for c, v in json.loads(options.get("anyOf", "{}")).items()}
        self.begins = {HEADERS[c]: v for c, v in json.loads(options.get("begins", "{}")).items()}

    def partitions(self) -> list[Files]:
        files = committed(self.folder)
        most = min(PARTITION_BYTES, sum(size for _, size in files) // self.parallelism + 1)
        parts: list[Files] = []
        room = 0
        for name, size in files:
            if not parts or size > room:
                parts.append(Files([]))
                room = most
            parts[-1].names.append(name)
            room -= size
        return parts

    def wanted(self, fields: dict[str, str]) -> bool:
        return all(fields.get(c) in v for c, v in self.any_of.items()) and all(
            c in fields and fields[c].startswith(v) for c, v in self.begins.items()
        )

    def records(self, name: str) -> Iterator[Record]:
        store, place = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(f"{place}/{name}") as source:
            window, at = Window(source), 0
            while at < window.size:
                record = Record(window, at)
                if self.wanted(record.fields):
                    yield record
                at = record.next()

    def value(self, column: str, record: Record, name: str) -> object:
        if column in HEADERS:
            return record.fields.get(HEADERS[column])
        return {
            "payload_length": record.payload_length,
            "payload": record.payload,
            "file": lambda: name,
            "offset": lambda: record.place,
        }[column]()

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        kinds = [ARROW.get(c, pa.string()) for c in self.columns]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(arrays, self.columns)

        rows: list[tuple] = []
        size = 0
        for name in partition.names:
            for record in self.records(name):
                if self.verify:
                    record.check()
                rows.append(tuple(self.value(c, record, name) for c in self.columns))
                size += record.length if "payload" in self.columns else 0
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.packed = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("fileBytes", str(FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, place = fs.FileSystem.from_uri(self.folder)
        names: list[str] = []
        target = None
        for batch in iterator:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                for row in batch.slice(start, BATCH_ROWS).to_pylist():
                    if target is None or target.tell() >= self.file_bytes:
                        if target is not None:
                            target.close()
                        store.create_dir(place, recursive=True)
                        names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                        target = store.open_output_stream(f"{place}/{names[-1]}", compression=None)
                    plain = record_bytes(row)
                    target.write(member_bytes(plain) if self.packed else plain)
        if target is not None:
            target.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, place = fs.FileSystem.from_uri(self.folder)
        store.create_dir(place, recursive=True)
        names = [name for message in messages if message for name in message.names]
        with store.open_output_stream(f"{place}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as target:
            target.write(json.dumps(names).encode())


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("archives are only added to: use the mode append")
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known."""
    spark.dataSource.register(WarcSource)


# ---- archives of pages ----

DIGEST = ["sha1", "bytes", "check"]


def marked(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """``key, url, payload, sha1, bytes, first`` of every page; ``first`` is the
    smallest id with the same payload, where several rows have it."""
    payload = F.coalesce(pages[f"`{html}`"], F.lit("")).cast("binary")
    rows = pages.select(
        pages[f"`{key}`"].cast("bigint").alias("key"), pages[f"`{url}`"].cast("string").alias("url"),
        payload.alias("payload"),
    ).select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"), F.xxhash64("payload").alias("check"))
    groups = rows.where(F.col("bytes") >= least).groupBy(*DIGEST).agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("first")
    )
    return lookup_join(rows, groups.where("n > 1").drop("n"), DIGEST, "left")


def archive(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Write one record per page to the folder."""
    register(pages.sparkSession)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    again = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first")))
    # the digest of the format is base32; five hex digits are four letters
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    fives = [F.conv(F.substring("sha1", 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    base = F.concat(*[
        F.substring(letters, F.shiftright(v, 15 - 5 * i).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in fives for i in range(4)
    ])
    rows = marked(pages, key, url, html, least).select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name("key").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(again, name("first")).alias("refers_to"),
        F.concat(F.lit("sha1:"), base).alias("payload_digest"),
        F.col("bytes").cast("bigint").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").option("compression", compression).save(folder)


def read(
    spark: SparkSession,
    folder: str,
    columns: str = SCHEMA,
    any_of: Mapping[str, Sequence[str | None]] | None = None,
    begins: Mapping[str, str] | None = None,
    verify: bool = False,
) -> DataFrame:
    """Records of a folder whose headers pass. ``columns`` is the part of ``SCHEMA``
    that is wanted; ``any_of`` lists the values a ``HEADERS`` column may have (None
    for a missing header), ``begins`` what one must begin with."""
    register(spark)
    options = {
        "anyOf": json.dumps({c: list(v) for c, v in (any_of or {}).items()}),
        "begins": json.dumps(dict(begins or {})),
        "verify": str(verify).lower(),
        "parallelism": str(spark.sparkContext.defaultParallelism),
    }
    return spark.read.format("warc").schema(columns).options(**options).load(folder)


def page_id(column: str) -> Column:
    """The page's id in a record id."""
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def write_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Archive all pages and describe them as read back, payloads checked."""
    session = pages.sparkSession
    folder = f"{shared_folder(session)}/{uuid.uuid4().hex}-warc"
    archive(pages, folder, key, url, html, least)
    wanted = "record_type string, record_id string, refers_to string, payload_digest string, payload_length bigint"
    pages_only = {"record_type": ["response", "revisit"]}
    return read(session, folder, wanted, pages_only, verify=True).select(
        page_id("record_id").alias(key),
        F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        page_id("refers_to").alias("refers_to"),
    )
