"""Near-duplicate groups by SimHash and a Gray-order index.

*Fingerprints.* ``A-Z`` is lowered, words between ASCII blanks form shingles of
``size`` words (repeats count; a shorter text is one shingle), each is hashed
with XXH64, seed 42, and a bit of the fingerprint is set if it is set in more
than half the hashes. A text without words has fingerprint zero.

*Index.* Distinct fingerprints, never their copies, go into the index. Two that
differ in at most two bits agree on at least one third of their bits, so every
fingerprint is entered three times, turned so that another third leads. Each
turn is sorted by Gray rank and cut into parts of equal size, whatever the
values are: a hot neighbourhood takes more parts, not a larger one. The bits
that all fingerprints of a part share (mask and pattern) are the upper node of
the part. A fingerprint visits a later part only if that part reaches into its
own leading third and its differences from the shared pattern are within the
bound. Inside a part a tree of such nodes over the sorted fingerprints is
descended for all queries at once; a subtree is left as soon as the differences
from what its members share exceed the bound. No partner or candidate is capped.

*Groups.* Every part reports a spanning forest of its links instead of all
links, and alternating star contractions join the forests. Their minima are
aggregated before the shuffle, so a hub needs no large task.

What is collected: one summary per part and turn. Everything between the steps
is a table in the shared folder. Null ids: such a document takes part in the
links; ``component_id`` is the smallest id that is not null, or null if there is
none. Repeated rows are labelled alike. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import MATCH, matching, packed
from corpusloom.sources.staging import stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
MAX_BITS = 2
TURNS = (0, 22, 43)
LEADING = 21
PART_ROWS = 200_000
FAN_OUT = 16
QUERY_BLOCK = 4096

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_OFFSET = np.arange(8, dtype=np.uint16) * 256
_LOW = np.uint64((1 << (64 - LEADING)) - 1)


# ---- fingerprints ----


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=len(shingles)
    )
    by_byte = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET
    counts = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    bits = 2 * counts.ravel() > len(shingles)
    return int(np.packbits(bits).view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """``key, digest, fp`` of every row; ``digest`` tells rows of one key apart."""
    body = docs[f"`{text}`"]
    source = docs.select(docs[f"`{key}`"].alias("key"), F.xxhash64(body).alias("digest"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(t.as_py(), size) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["digest"], pa.array(codes, pa.int64())], ["key", "digest", "fp"]
            )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, digest bigint, fp bigint")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- the index ----


def _turned(code: Column, by: int) -> Column:
    if not by:
        return code
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order: the running parity of its bits."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def _index(codes: DataFrame, rows: int) -> DataFrame:
    """All turns in Gray order, cut into parts of about equal size."""
    turns = [
        codes.select(F.lit(i).alias("turn"), "fp", _turned(F.col("fp"), by).alias("code"))
        for i, by in enumerate(TURNS)
    ]
    entries = turns[0].union(turns[1]).union(turns[2]).withColumn("rank", gray_rank(F.col("code")))
    session = codes.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-3 * rows // PART_ROWS))
    ranged = entries.repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank")
    return stage(ranged.withColumn("part", F.spark_partition_id()))


def _upper_nodes(index: DataFrame) -> dict[int, np.ndarray]:
    """Per turn the parts in order: part, first rank, shared bits, pattern."""
    nodes = (
        index.groupBy("turn", "part")
        .agg(
            F.min("rank").alias("first"),
            F.expr("~(bit_and(code) ^ bit_or(code))").alias("mask"),
            F.expr("bit_and(code)").alias("pattern"),
        )
        .orderBy("turn", "part")
        .collect()
    )
    by_turn: dict[int, list] = {}
    for n in nodes:
        by_turn.setdefault(n["turn"], []).append((n["part"], n["first"], n["mask"], n["pattern"]))
    return {turn: np.array(rows, dtype=np.int64) for turn, rows in by_turn.items()}


def _visits(index: DataFrame, nodes: dict[int, np.ndarray], bits: int) -> DataFrame:
    """Fingerprints that must also be looked up in a later part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("turn", "fp", "code", "rank", "part")}
            for turn, table in nodes.items():
                mine = np.flatnonzero(got["turn"] == turn)
                place = np.searchsorted(table[:, 0], got["part"][mine])
                cell_end = got["rank"][mine] | np.int64(_LOW)
                last = np.searchsorted(table[:, 1], cell_end, side="right") - 1
                step = 1
                while len(open_ := np.flatnonzero(place + step <= last)):
                    mine, place, last = mine[open_], place[open_], last[open_]
                    node = table[place + step]
                    away = np.bitwise_count(((got["code"][mine] ^ node[:, 3]) & node[:, 2]).view(np.uint64))
                    hit = away <= bits
                    if hit.any():
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(got["turn"][mine[hit]], pa.int32()),
                                pa.array(node[hit, 0], pa.int32()),
                                pa.array(got["fp"][mine[hit]], pa.int64()),
                                pa.array(got["code"][mine[hit]], pa.int64()),
                                pa.array(got["rank"][mine[hit]], pa.int64()),
                            ],
                            ["turn", "part", "fp", "code", "rank"],
                        )
                    step += 1

    return index.mapInArrow(run, "turn int, part int, fp bigint, code bigint, rank bigint")


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared bits, pattern) of the nodes of a tree over sorted codes, leaves'
    parents first; every node has up to FAN_OUT children."""
    both, any_ = codes, codes
    levels = []
    while len(both) > 1:
        starts = np.arange(0, len(both), FAN_OUT)
        both, any_ = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(any_, starts)
        levels.append((~(both ^ any_), both))
    return levels


def links_in(codes: np.ndarray, guests: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, member) within ``bits`` whose leading thirds agree.

    ``codes`` are in Gray order; queries are the codes themselves, each against
    later ones, and after them the guests against all.
    """
    levels = _levels(codes)
    queries = np.concatenate([codes, guests])
    for begin in range(0, len(queries), QUERY_BLOCK):
        q = np.arange(begin, min(begin + QUERY_BLOCK, len(queries)))
        node = np.zeros(len(q), dtype=np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            mask, pattern = levels[depth]
            apart = (queries[q] ^ pattern[node]) & mask[node]
            near = (np.bitwise_count(apart) <= bits) & (apart & ~_LOW == 0)
            width = FAN_OUT ** (depth + 1)
            near &= (q >= len(codes)) | ((node + 1) * width > q + 1)
            below = len(levels[depth - 1][0]) if depth else len(codes)
            q, node = q[near], node[near]
            node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            q = np.repeat(q, FAN_OUT)[node < below]
            node = node[node < below]
        if not levels:
            node = np.zeros(len(q) if len(codes) else 0, dtype=np.int64)
            q = q[: len(node)]
        apart = queries[q] ^ codes[node]
        near = (np.bitwise_count(apart) <= bits) & (apart & ~_LOW == 0)
        near &= (q >= len(codes)) | (node > q)
        yield q[near], node[near]


def _forest(size: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each element's group."""
    root = np.arange(size)
    for a, b in links:
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(upper := root[root], root):
                root = upper
    return root


def _part_links(table: pa.Table, bits: int) -> pa.Table:
    """A spanning forest of the links in one part, as pairs of fingerprints."""
    own = table["guest"].to_numpy() == 0
    fp = table["fp"].to_numpy()
    code = table["code"].to_numpy().view(np.uint64)
    rank = table["rank"].to_numpy()
    order = np.flatnonzero(own)[np.argsort(rank[own], kind="stable")]
    away = np.flatnonzero(~own)
    both = np.concatenate([order, away])
    root = _forest(len(both), links_in(code[order], code[away], bits))
    tied = np.flatnonzero(root != np.arange(len(both)))
    return pa.table({"a": fp[both[tied]], "b": fp[both[root[tied]]]})


def links(codes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links between distinct fingerprints ``fp``, reduced to forests."""
    index = _index(codes, codes.count())
    nodes = _upper_nodes(index)
    columns = ("turn", "part", "fp", "code", "rank")
    own = index.select(*columns, F.lit(0).alias("guest"))
    visiting = _visits(index, nodes, bits).select(*columns, F.lit(1).alias("guest"))
    found = (
        own.union(visiting)
        .groupBy("turn", "part")
        .applyInArrow(lambda t: _part_links(t, bits), "a bigint, b bigint")
    )
    return stage(found.where(F.col("a") != F.col("b")).distinct())


# ---- groups ----


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``edges (a, b)``; the root is the smallest.

    Large star: every node hands its larger neighbours to its smallest one.
    Small star: every node hands its smaller neighbours to the smallest. Both
    alternate until every edge points at a root.
    """
    pairs = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    while True:
        both = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(
            pairs.select(F.col("v").alias("a"), F.col("u").alias("b"))
        )
        least = both.groupBy("b").agg(F.min("a").alias("m")).select("b", F.least("b", "m").alias("m"))
        large = (
            both.where(F.col("a") > F.col("b"))
            .join(least, "b")
            .select(F.col("a").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        least_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least_of, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least_of.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        pairs = stage(small)
        # done when no root has a parent and no node has two
        nested = pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not nested and pairs.count() == pairs.select("u").distinct().count():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled(docs: DataFrame, key: str, text: str, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``key, digest, fp, first`` per row; ``first`` is a struct of the key and
    digest of the group's first row (smallest key, nulls last)."""
    rows = stage(fingerprints(docs, key, text, size))
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "digest")
    codes = stage(rows.groupBy("fp").agg(F.min(place).alias("first")))
    tree = components(links(codes.select("fp"), bits))
    grouped = codes.join(tree, codes["fp"] == tree["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    grouped = stage(grouped)
    firsts = grouped.groupBy("root").agg(F.min("first").alias("first"))
    per_code = grouped.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(per_code, "fp").select("key", "digest", "fp", "first")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, fingerprint and the smallest key of its group."""
    found = labelled(docs, key, text)
    return found.select(
        F.col("key").alias(key), hex16(F.col("fp")).alias("fingerprint"), F.col("first.key").alias("component_id")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns it came with."""
    found = labelled(docs, key, text)
    chosen = found.select(*matching(F.col("first.key"), F.col("first.digest"))).distinct()
    row = packed(docs, key=docs[f"`{key}`"], digest=F.xxhash64(docs[f"`{text}`"]))
    kept = row.select("row", *matching(F.col("key"), F.col("digest"))).join(chosen, MATCH)
    nth = F.row_number().over(Window.partitionBy(*MATCH).orderBy(F.lit(0)))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*")
