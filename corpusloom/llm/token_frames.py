"""Token ids of documents in seekable, compressed files.

A file holds the documents of one key range in order. Each document is one
independent zstandard frame of its ids (little-endian, two bytes each if the
vocabulary allows, else four). Two skippable frames follow, which plain
decompressors ignore: an index (key, validity, number of ids per document, and
the width of an id) and, last, the seek table of the zstandard seekable format:
compressed size, size and checksum (low half of XXH64) of every frame. A reader
fetches the tail, and then only the frames of the documents it wants.

*Writing.* Texts are sorted by key range, once, then encoded and written by one
task per range through the file system of the target folder. A task writes
under a name of its own and reports it; a lost or repeated attempt leaves a file
that no manifest names. The manifest, a row per file, is a table; running sums
over it give the position of each file's first id.

*Encoding.* Blanks never are inside a token, so a text may be cut at blanks;
equal pieces have equal ids, and bounded memos per worker keep them. A piece of
letters only is one word to the tokenizer and goes straight to its merge model.

Null text is an empty text: the end id only. Null keys come first; equal keys
follow each other in the order of a hash of their texts. Repeated rows are
written once each. An empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import struct
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.sources.staging import shared_folder, stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_FILE = 20_000
LEVEL = 3
MEMO = 600_000
MEMO_LENGTH = 32

# fixed values of the zstandard skippable and seekable formats
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
FOOTER = "<IBI"
SKIPPABLE = "<II"
FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
ENTRY = np.dtype([("key", "<i8"), ("valid", "u1"), ("n", "<u4")])
INDEX_TAIL = "<BII"


# ---- encoding ----


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if
    printable, else one from 256 upwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo(dict):
    """A bounded map that computes what it lacks; what was used lately survives
    when it is full."""

    def __init__(self, compute: Callable[[str], bytes]) -> None:
        super().__init__()
        self.compute = compute
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of texts by a tokenizer file, with bounded memos of pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.letter = "H" if self.width == 2 else "I"
        self.letters = byte_letters()
        self.pieces, self.words, self.others = Memo(self.piece), Memo(self.word), Memo(self.plain)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def plain(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, low: str) -> bytes:
        """Ids of lower-case letters: one token of the cutting pattern."""
        letters = low.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(letters)])

    def core(self, text: str) -> bytes:
        """Ids of a piece, or of its part without a mark at the end."""
        low, ascii_ = text.lower(), text.isascii()
        # lower case by letter: only that of sigma depends on its place
        if low.isalpha() and (
            ascii_ or (len(low) == len(text) and "\u03a3" not in text and is_normalized("NFC", text))
        ):
            return self.words[low]
        return self.others[low if ascii_ else text]

    def piece(self, text: str) -> bytes:
        """Ids of a piece between blanks."""
        # a mark behind a letter or digit begins a token of its own
        if len(text) > 1 and text[-1] in ",." and len(low := text[-2].lower()) == 1 and low.isalnum():
            return self.core(text[:-1]) + self.core(text[-1])
        return self.core(text)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


def encoder_of(path: str) -> Encoder:
    """The worker's encoder; workers outlive tasks, and so does the memo."""
    store = sys.modules.setdefault("_token_frames_store", types.ModuleType("_token_frames_store"))
    if path not in store.__dict__:
        store.__dict__[path] = Encoder(path)
    return store.__dict__[path]


# ---- files ----


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack(SKIPPABLE, magic, len(body)) + body


def write_file(target: pa.NativeFile, documents: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write (key, ids) in the given order; returns the numbers of documents and ids."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    frames, entries = [], []
    for key, ids in documents:
        packed = packer.compress(ids)
        target.write(packed)
        frames.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        entries.append((key or 0, key is not None, len(ids) // width))
    index = np.array(entries, dtype=ENTRY).tobytes()
    target.write(_skippable(INDEX_MAGIC, index + struct.pack(INDEX_TAIL, width, len(entries), zlib.crc32(index))))
    seek = np.array(frames, dtype=FRAME).tobytes() + struct.pack(FOOTER, len(frames), HAS_CHECKSUMS, FOOTER_MAGIC)
    target.write(_skippable(SEEK_MAGIC, seek))
    return len(entries), sum(e[2] for e in entries)


class Reader:
    """Documents of one file; decompresses only what is asked for."""

    def __init__(self, source: pa.NativeFile) -> None:
        import zstandard

        self.source = source
        self.unpacker = zstandard.ZstdDecompressor()
        end = source.size()
        n, flags, magic = struct.unpack(FOOTER, self._at(end - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != FOOTER_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        seek = end - struct.calcsize(FOOTER) - n * FRAME.itemsize
        self.frames = np.frombuffer(self._at(seek, n * FRAME.itemsize), dtype=FRAME)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        # the index begins behind the last frame
        magic, length = struct.unpack(SKIPPABLE, self._at(int(self.starts[-1]), struct.calcsize(SKIPPABLE)))
        body = self._at(int(self.starts[-1]) + struct.calcsize(SKIPPABLE), length)
        self.width, count, check = struct.unpack(INDEX_TAIL, body[-struct.calcsize(INDEX_TAIL) :])
        index = body[: -struct.calcsize(INDEX_TAIL)]
        if magic != INDEX_MAGIC or count != n or zlib.crc32(index) != check:
            raise ValueError("damaged index")
        self.entries = np.frombuffer(index, dtype=ENTRY)

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def key(self, i: int) -> int | None:
        return int(self.entries["key"][i]) if self.entries["valid"][i] else None

    def find(self, key: int) -> list[int]:
        """Places of the documents with this key."""
        return np.flatnonzero((self.entries["key"] == key) & (self.entries["valid"] == 1)).tolist()

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, checked."""
        import xxhash

        packed = self._at(int(self.starts[i]), int(self.frames["packed"][i]))
        size = int(self.frames["size"][i])
        raw = self.unpacker.decompress(packed, max_output_size=size) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["checksum"][i]:
            raise ValueError(f"document {i}: wrong checksum")
        return np.frombuffer(raw, dtype=f"<u{self.width}")


# ---- jobs ----


def write(docs: DataFrame, folder: str, tokenizer: str, end_ids: Sequence[int] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents in ascending key order; the manifest
    (``part, file, documents, tokens, start``), a row per file."""
    session = docs.sparkSession
    rows = docs.select(docs[f"`{key}`"].cast("bigint").alias("key"), docs[f"`{text}`"].alias("text"))
    files = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_PER_FILE))
    by = [F.asc_nulls_first("key"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(files, *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoder = encoder_of(tokenizer)
        tail = np.array(end_ids, dtype=encoder.kind).tobytes()
        part = TaskContext.get().partitionId()
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"

        def documents() -> Iterator[tuple[int | None, bytes]]:
            batch = first
            while batch is not None:
                for k, t in zip(batch["key"].to_pylist(), batch["text"]):
                    yield k, encoder.ids(t.as_py() or "") + tail
                batch = next(batches, None)

        # the frames are compressed already, whatever the suffix suggests
        with store.open_output_stream(f"{place}/{name}", compression=None) as target:
            n, tokens = write_file(target, documents(), encoder.width)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "documents": [n], "tokens": [tokens]})

    written = stage(ordered.mapInArrow(run, "part bigint, file string, documents bigint, tokens bigint"))
    # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, from the files."""
    session = manifest.sparkSession
    spread = manifest.repartition(int(session.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                with store.open_input_file(f"{place}/{name}") as source:
                    reader = Reader(source)
                    keys, starts, counts, sums = [], [], [], []
                    for i in range(len(reader.entries)):
                        ids = reader.ids(i)
                        keys.append(reader.key(i))
                        starts.append(start)
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (keys, starts, counts, sums)],
                    ["key", "start", "n_tokens", "ids_crc32"],
                )

    return spread.mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(docs: DataFrame) -> str:
    """A fresh folder for files of this application."""
    return f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}-frames"


def write_and_read(docs: DataFrame, tokenizer: str, end_ids: Sequence[int] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents and describe them as read back."""
    folder = new_folder(docs)
    return read(write(docs, folder, tokenizer, end_ids, key, text), folder).withColumnRenamed("key", key)
