"""Byte-level BPE by ranked merges, encoding and decoding.

*Distinct words.* Texts are cut by the pattern and each match is encoded alone,
so equal words have equal ids. Words are counted over the corpus (summed before
the shuffle), and the most frequent distinct ones are encoded by a fold of
higher-order functions: the bytes of a word start as one piece each, a step
joins the leftmost neighbours whose joined bytes have the lowest rank, until no
neighbours have a rank. The ranks are one literal value in the plan, hashed into
buckets because Spark finds a key of a map by scanning it. The result is a
dictionary bounded by ``HEAD_WORDS`` and ``HEAD_BYTES`` per word.

*Documents* are encoded in Arrow batches with the dictionary. A word outside of
it is merged by the same ranks where it stands, in ``n log n`` for any length,
and kept in a bounded memo. No text is shuffled. (Folding these words by
higher-order functions in place gives the same ids at twice the cost; see the
README.) Decoding concatenates the bytes of the ids.

Null text is an empty text: no ids, no bytes. Repeated rows are encoded alike.
Every byte is a token, so any text can be encoded. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpusloom.llm.common import let, slices
from corpusloom.sources.staging import stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD_WORDS = 1 << 17
HEAD_BYTES = 64
BUCKETS = 1 << 16
NO_RANK = 2**31 - 1
# words a worker remembers beside the dictionary; most others come once
MEMO = 1 << 15


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    """The word pattern with Unicode white space, as tokenizer libraries read it."""
    return "(?U)" + pattern


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


# ---- literal tables ----


def _bucket(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _look_up(buckets: Column, key: Column) -> Column:
    return F.try_element_at(F.get(buckets, _bucket(key)), key)


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: ranks by hex bytes, in buckets."""
    slots: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        slots[xxhash.xxh64_intdigest(key, 42) & (BUCKETS - 1)][key] = rank
    # by Arrow, as rows would pass through Python workers, which stay and take memory
    kind = pa.list_(pa.map_(pa.string(), pa.int32()))
    row = pa.table({"buckets": pa.array([[list(slot.items()) for slot in slots]], kind)})
    return spark.createDataFrame(row, "buckets array<map<string,int>>")


# ---- merges ----


def _rank(buckets: Column, piece: Column) -> Column:
    return F.coalesce(_look_up(buckets, piece), F.lit(NO_RANK))


def _merged(bytes_: Column, buckets: Column) -> Column:
    """Ids of a word of two or more bytes, given in hex.

    The state holds the pieces and the ranks of neighbours; a merge changes one
    piece and two ranks.
    """
    strings, ints = F.array().cast("array<string>"), F.array().cast("array<int>")

    def merge(state: Column, k: Column) -> Column:
        pieces, ranks = state["pieces"], state["ranks"]

        def put(joined: Column) -> Column:
            left = F.when(k > 1, F.array(_rank(buckets, F.concat(F.get(pieces, k - 2), joined)))).otherwise(ints)
            right = F.when(
                k + 1 < F.size(pieces), F.array(_rank(buckets, F.concat(joined, F.get(pieces, k + 1))))
            ).otherwise(ints)
            return F.struct(
                F.concat(
                    F.slice(pieces, F.lit(1), k - 1), F.array(joined), F.slice(pieces, k + 2, F.size(pieces))
                ).alias("pieces"),
                F.concat(
                    F.slice(ranks, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right,
                    F.slice(ranks, k + 2, F.size(pieces)),
                ).alias("ranks"),
            )

        return let(F.concat(F.get(pieces, k - 1), F.get(pieces, k)), put)

    def step(state: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            place = F.array_position(state["ranks"], least).cast("int")
            return F.when(F.coalesce(least, F.lit(NO_RANK)) == NO_RANK, state).otherwise(
                let(place, lambda k: merge(state, k))
            )

        return let(F.array_min(state["ranks"]), at)

    n = F.floor(F.length(bytes_) / 2).cast("int")
    start = F.struct(
        F.concat(strings, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(bytes_, 2 * i + 1, F.lit(2)))).alias("pieces"),
        F.concat(ints, F.transform(F.sequence(F.lit(0), n - 2), lambda i: _rank(buckets, F.substring(bytes_, 2 * i + 1, F.lit(4))))).alias("ranks"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), n - 1), start, step, lambda state: F.transform(state["pieces"], lambda p: _look_up(buckets, p))
    )


def fold(word: Column, buckets: Column) -> Column:
    """Ids of one word that is not empty."""

    def of(bytes_: Column) -> Column:
        return let(
            _look_up(buckets, bytes_),
            lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(_merged(bytes_, buckets)),
        )

    return let(F.hex(word), of)


def head(docs: DataFrame, text: str, pattern: str, ranks: dict[bytes, int], words: int = HEAD_WORDS) -> DataFrame:
    """``word, ids`` of the most frequent distinct words, at most ``words``."""
    own = docs.select(F.explode(split_words(docs[f"`{text}`"], pattern)).alias("word"))
    counts = own.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.where((F.col("n") > 1) & (F.octet_length("word") <= HEAD_BYTES)))
    # the lowest count with at most ``words`` words at or above it; one row per
    # different count, and there are few of those
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    above = by_count.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("total"))
    lowest = above.where(F.col("total") <= words).agg(F.min("n").alias("n")).first()["n"]
    frequent = counts.where(F.col("n") >= lowest) if lowest is not None else counts.limit(0)
    # the table is named once, so that it reaches the expression as a reference
    # and is not copied into rows
    with_ranks = frequent.select("word", rank_table(docs.sparkSession, ranks).select("buckets").scalar().alias("b"))
    return stage(with_ranks.select("word", let(F.col("b"), lambda b: fold(F.col("word"), b)).alias("ids")))


# ---- arrays ----
#
# Made of buffers: pa.array() imports pandas, which takes 40 MB of every worker.


def _offsets(lengths: list[int]) -> np.ndarray:
    return np.cumsum([0, *lengths], dtype=np.int32)


def _numbers(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(values)])


def _strings(values: list[bytes]) -> pa.Array:
    """Strings, given in UTF-8."""
    buffers = [None, pa.py_buffer(_offsets(list(map(len, values)))), pa.py_buffer(b"".join(values))]
    return pa.Array.from_buffers(pa.string(), len(values), buffers)


def _lists(values: list[bytes]) -> pa.Array:
    """Lists of numbers, four little-endian bytes each."""
    flat = _numbers(np.frombuffer(b"".join(values), "<i4"), pa.int32())
    offsets = pa.py_buffer(_offsets([len(v) // 4 for v in values]))
    return pa.Array.from_buffers(pa.list_(pa.int32()), len(values), [None, offsets], children=[flat])


# ---- documents ----


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: lowest rank first, leftmost first."""
    if word in ranks:
        return [ranks[word]]
    n, get = len(word), ranks.get
    # a piece is known by its start; ends[start] is where the next one starts
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        middle = ends[i]
        # outdated if either piece is gone or has grown
        if not middle or middle >= n or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            if (r := get(word[i : ends[end]])) is not None:
                heappush(heap, (r, i, ends[end]))
        if i:
            left = before[i]
            if (r := get(word[left:end])) is not None:
                heappush(heap, (r, left, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return ids


class Coder(dict):
    """Words to ids (four little-endian bytes each), as a bounded memo in front
    of the dictionary and the merges."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        super().__init__()
        self.known, self.ranks = known, ranks
        self.cut = regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def __missing__(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = np.array(merge(word.encode(), self.ranks), "<u4").tobytes()
        if len(word) <= HEAD_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder_for(docs: DataFrame, text: str, ranks: dict[bytes, int], pattern: str):
    """A function that gives a worker its coder; the dictionary is broadcast,
    which ``HEAD_WORDS`` and ``HEAD_BYTES`` bound."""
    known = {
        r["word"]: np.array(r["ids"], "<u4").tobytes() for r in head(docs, text, pattern, ranks).toLocalIterator()
    }
    sent = docs.sparkSession.sparkContext.broadcast((known, ranks))
    name = f"coder-{sent._jbroadcast.id()}-{docs.sparkSession.sparkContext.applicationId}"

    def coder() -> Coder:
        # workers outlive tasks, and so do their coder and its memo
        store = sys.modules.setdefault("_bpe_store", types.ModuleType("_bpe_store")).__dict__
        if name not in store:
            for old in [k for k in store if k.startswith("coder-")]:
                del store[old]
            store[name] = Coder(*sent.value, pattern)
        return store[name]

    return coder


def digests(docs: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per row: key, number of ids, SHA-256 of the ids and of the decoded bytes."""
    coder = _coder_for(docs, text, ranks, pattern)
    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in slices(batches):
            counts, sums, decoded = [], [], []
            for t in batch["text"]:
                ids = own.encode(t.as_py() or "")
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest().encode())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest().encode())
            yield pa.RecordBatch.from_arrays(
                [batch["key"], _numbers(np.array(counts, np.int64), pa.int64()), _strings(sums), _strings(decoded)],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, text: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The documents with ``ids`` and with ``text`` decoded from them; a column
    that was called ``ids`` before gives way."""
    coder = _coder_for(docs, text, ranks, pattern)
    others = [docs[f"`{c}`"] for c in docs.columns if c != text]
    source = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in slices(batches):
            coded = [own.encode(t.as_py() or "") for t in batch["text"]]
            texts = _strings([own.decode(ids) for ids in coded])
            yield pa.RecordBatch.from_arrays([batch["row"], texts, _lists(coded)], ["row", "text", "ids"])

    schema = T.StructType(
        [source.schema["row"], T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    decoded = source.mapInArrow(run, schema)
    kept = [(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c.lower() != "ids"]
    return decoded.select(*kept, "ids")
