"""Hard negatives of anchors: rows of another label that score somewhat below a
positive, found by one-bit codes and scored exactly.

*Index.* Every vector becomes integers, ``floor(GRID * c)``, and is rotated (signs
drawn once and Hadamard transforms). A one-bit code holds the signs ``o`` of the
rotated vector, over the root of their number; stored beside it is the alignment
``<x, o>``. What code and alignment leave of the vector is rotated again and gets the
next code, ``LEVELS`` in all: one alone leaves 0.6 of a random vector's norm, too
much for an interval to tell anything, six leave 0.05. That last norm is stored too.

*Filter.* An anchor's rotated vectors are rounded to ``BITS`` bits per entry, kept as
bit planes, so ``<anchor, o>`` is a sum of popcounts of code and plane. By Cauchy and
Schwarz the score differs from the sum of alignments times these by no more than
``|anchor| * left`` and, for each code, alignment times the norm of what was rounded
off: an interval that holds the score for certain. Only rows whose interval may
reach the best ones are scored, by integer products.

*Search.* Anchors are a query set, here about a hundredth of the rows. Rows are
dealt to groups and anchors to blocks, both bounded by ``ENTRIES`` vector entries;
every group meets every block once and hands on its best per anchor. First the
positives are found, among rows of the anchor's label only, then the negatives.
Nothing is approximate: a row is left out when its interval proves that enough
rows of its own group are before it.

Rows with a null label, a null vector, or a null or non-finite entry take no
part. Repeated rows are rows of their own, so a copy of an anchor may be its
positive. A null id is no anchor and comes last among equal scores. Shorter
vectors are filled up with zeros to the longest. An empty table gives an empty
result. Scores beyond 64 bits fail the job.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.whitening import _vectors, integers
from corpusloom.sources.staging import stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules["corpusloom.llm.whitening"])

LEVELS = 6
BITS = 7
SEED = 11
# entries of the vectors of a group or block, pairs that are estimated at once
ENTRIES = 1 << 22
PAIRS = 1 << 17
# of the largest possible score, for the rounding of the estimate itself
ROUNDING = 1e-9

INDEX = "uid bigint, id bigint, label bigint, x array<bigint>, codes binary, aligned array<double>, left double, norm double"
POSITIVE = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, score bigint"
NEGATIVE = (
    "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, "
    "negative bigint, negative_id bigint, negative_score bigint"
)
ARROW = {"bigint": pa.int64(), "double": pa.float64()}


# ---- codes ----


def width(dims: int) -> int:
    """Entries of a rotated vector: a power of two, whole words of 64 bits."""
    return max(64, 1 << (max(dims, 1) - 1).bit_length())


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows under a rotation that depends on their length only."""
    size = width(x.shape[1])
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (2, size))
    for sign in signs:
        y = y * sign
        step = 1
        while step < size:
            y = y.reshape(len(x), -1, 2, step)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
            step *= 2
        y = y.reshape(len(x), size) / np.sqrt(size)
    return y


class Codes(NamedTuple):
    """One-bit codes of rows: signs as words, alignment, what is left, norm."""

    words: np.ndarray  # rows, levels, words
    aligned: np.ndarray  # rows, levels
    left: np.ndarray
    norm: np.ndarray


def encode(x: np.ndarray) -> Codes:
    y, root = x, np.sqrt(width(x.shape[1]))
    words, aligned = [], []
    for _ in range(LEVELS):
        y = rotated(y)
        positive = y > 0
        words.append(np.packbits(positive, axis=1, bitorder="little").view(np.uint64))
        aligned.append(np.abs(y).sum(axis=1) / root)
        y = y - np.where(positive, 1.0, -1.0) * (aligned[-1] / root)[:, None]
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    return Codes(np.stack(words, axis=1), np.stack(aligned, axis=1), np.sqrt((y * y).sum(axis=1)), norm)


def intervals(anchors: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """For every anchor and row, bounds between which their score lies."""
    y, size = anchors, width(anchors.shape[1])
    norm = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    estimate = np.zeros((len(anchors), len(codes.left)))
    half = norm[:, None] * (codes.left + ROUNDING * (1 + codes.norm))[None, :] + ROUNDING
    for level in range(codes.words.shape[1]):
        y = rotated(y)
        low = y.min(axis=1)
        step = (y.max(axis=1) - low) / (2**BITS - 1)
        grid = np.rint((y - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
        q = low[:, None] + step[:, None] * grid
        words, aligned = codes.words[:, level], codes.aligned[None, :, level]
        # what the bit planes of the grid have in common with the code
        weighted = np.zeros(estimate.shape, np.int32)
        for b in range(BITS):
            plane = np.packbits((grid >> b) & 1 == 1, axis=1, bitorder="little").view(np.uint64)
            for w in range(words.shape[1]):
                weighted += np.bitwise_count(words[None, :, w] & plane[:, None, w]).astype(np.int32) << b
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        inside = step[:, None] * weighted + low[:, None] * ones[None, :]
        estimate += aligned * ((2 * inside - q.sum(axis=1)[:, None]) / np.sqrt(size))
        half += aligned * np.sqrt(((y - q) ** 2).sum(axis=1))[:, None]
    return estimate - half, estimate + half


def scores(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(x.shape[1], 1)
    if most < 2.0**53:
        return (x.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return x @ anchor
    exact = x.astype(object) @ anchor.astype(object)
    if len(exact) and max(map(abs, exact)) >= 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


# ---- one group of rows and one block of anchors ----


def nth_largest(values: np.ndarray, n: int) -> float:
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


class Rows(NamedTuple):
    uid: np.ndarray
    id: np.ndarray
    known: np.ndarray
    label: np.ndarray
    x: np.ndarray
    codes: Codes

    def take(self, places: np.ndarray) -> Rows:
        return Rows(*[v[places] for v in self[:5]], Codes(*[v[places] for v in self.codes]))

    def best(self, places: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of the places by score, then id."""
        order = np.lexsort((self.uid[places], self.id[places], ~self.known[places], -found))
        return order[:n]

    def name(self, place: int) -> int | None:
        return int(self.id[place]) if self.known[place] else None


def unpacked(table: pa.Table, dims: int) -> Rows:
    batch = table.combine_chunks()
    column = lambda name: batch[name].combine_chunks()
    words = width(dims) // 64
    codes = np.frombuffer(b"".join(column("codes").to_pylist()), np.uint64).reshape(-1, LEVELS, words)
    aligned = column("aligned").flatten().to_numpy(zero_copy_only=False).reshape(-1, LEVELS)
    ids = column("id")
    return Rows(
        column("uid").to_numpy(zero_copy_only=False),
        ids.fill_null(0).to_numpy(zero_copy_only=False),
        ids.is_valid().to_numpy(zero_copy_only=False),
        column("label").to_numpy(zero_copy_only=False),
        _vectors({"x": column("x")}, dims),
        Codes(codes, aligned, column("left").to_numpy(), column("norm").to_numpy()),
    )


def positives_of(rows: Rows, anchors: Rows, most: int) -> list[tuple]:
    """The best rows of the group with an anchor's label."""
    out = []
    for label in np.unique(anchors.label):
        asked, there = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        if not len(there):
            continue
        given = rows.take(there)
        for start in range(0, len(asked), max(1, PAIRS // len(there))):
            some = asked[start : start + max(1, PAIRS // len(there))]
            low, high = intervals(anchors.x[some], given.codes)
            for i, a in enumerate(some):
                other = given.uid != anchors.uid[a]
                least = nth_largest(low[i][other], most)
                places = np.flatnonzero(other & (high[i] >= least))
                found = scores(given.x[places], anchors.x[a])
                for k in given.best(places, found, most):
                    p = places[k]
                    out.append((int(anchors.uid[a]), anchors.name(a), int(given.uid[p]), given.name(p), int(found[k])))
    return out


def bounds(score: int, least: int, greatest: int) -> tuple[int, int]:
    """Scores from ``least`` to ``greatest`` hundredths of a positive's."""
    return -((-least * score) // 100), (greatest * score) // 100


def negatives_of(rows: Rows, anchors: Rows, wanted: list[list[dict]], most: int, least: int, greatest: int) -> list[tuple]:
    """For every positive of an anchor the best rows of the group with another
    label and a score in its range."""
    out = []
    chunk = max(1, PAIRS // max(len(rows.uid), 1))
    for start in range(0, len(anchors.uid), chunk):
        some = range(start, min(start + chunk, len(anchors.uid)))
        low, high = intervals(anchors.x[some.start : some.stop], rows.codes)
        for i, a in enumerate(some):
            other = rows.label != anchors.label[a]
            ranges = [(p, *bounds(p["score"], least, greatest)) for p in wanted[a]]
            reach = np.zeros(len(rows.uid), bool)
            for _, first, last in ranges:
                if first > last:
                    continue
                may = other & (high[i] >= first) & (low[i] <= last)
                surely = low[i][may & (low[i] >= first) & (high[i] <= last)]
                reach |= may & (high[i] >= nth_largest(surely, most))
            places = np.flatnonzero(reach)
            found = scores(rows.x[places], anchors.x[a])
            for p, first, last in ranges:
                inside = np.flatnonzero((found >= first) & (found <= last))
                for k in rows.best(places[inside], found[inside], most):
                    n = places[inside[k]]
                    out.append((
                        int(anchors.uid[a]), anchors.name(a), p["positive"], p["positive_id"], p["score"],
                        int(rows.uid[n]), rows.name(n), int(found[inside[k]]),
                    ))
    return out


# ---- jobs ----


def index(table: DataFrame, key: str, label: Column, vector: str) -> tuple[DataFrame, int]:
    """Rows that take part with their codes (``INDEX``, staged), and the length
    of the longest vector."""
    x = integers(table[f"`{vector}`"])
    rows = stage(table.select(
        F.monotonically_increasing_id().alias("uid"), table[f"`{key}`"].cast("bigint").alias("id"),
        label.cast("bigint").alias("label"), x.alias("x"),
    ).where(F.col("x").isNotNull() & F.col("label").isNotNull()))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    piece = max(1, PAIRS // width(dims))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, piece):
                part = batch.slice(start, piece)
                codes = encode(_vectors(part, dims))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part[c] for c in ("uid", "id", "label", "x")],
                        pa.array([w.tobytes() for w in codes.words], pa.binary()),
                        pa.array(list(codes.aligned), pa.list_(pa.float64())),
                        pa.array(codes.left),
                        pa.array(codes.norm),
                    ],
                    ["uid", "id", "label", "x", "codes", "aligned", "left", "norm"],
                )

    return stage(rows.mapInArrow(run, INDEX)), dims


def _met(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], schema: str, work: Callable) -> DataFrame:
    """``work(rows, anchors)`` of every group of rows and block of anchors."""
    groups, blocks = sizes
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("g", dealt(groups, 1)).withColumn("b", every(blocks))
    right = anchors.withColumn("b", dealt(blocks, 2)).withColumn("g", every(groups))
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def run(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        found = work(left_rows, right_rows) if left_rows.num_rows and right_rows.num_rows else []
        return pa.table({n: pa.array([r[i] for r in found], ARROW[k]) for i, (n, k) in enumerate(zip(names, kinds))})

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, schema)


def _first(df: DataFrame, by: list[str], score: str, name: str, uid: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(name), uid)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    table: DataFrame,
    anchor: Callable[[Column], Column],
    key: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    greatest: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. ``anchor`` tells by its id whether a row is one; a negative
    scores ``least`` to ``greatest`` hundredths of its positive."""
    label = table[f"`{label}`"] if isinstance(label, str) else label
    rows, dims = index(table, key, label, vector)
    asked = stage(rows.where(F.coalesce(anchor(F.col("id")), F.lit(False))))
    most = max(1, ENTRIES // width(dims))
    parallelism = table.sparkSession.sparkContext.defaultParallelism
    sizes = max(4 * parallelism, -(-rows.count() // most)), max(1, -(-asked.count() // most))

    def nearest(left: pa.Table, right: pa.Table) -> list[tuple]:
        return positives_of(unpacked(left, dims), unpacked(right, dims), positives)

    best = stage(_first(_met(rows, asked, sizes, POSITIVE, nearest), ["anchor"], "score", "positive_id", "positive", positives))
    # at most the number of positives a list
    lists = best.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "score")).alias("wanted"))
    known = stage(asked.join(lists, F.col("uid") == F.col("anchor")).drop("anchor"))

    def below(left: pa.Table, right: pa.Table) -> list[tuple]:
        wanted = right["wanted"].to_pylist()
        return negatives_of(unpacked(left, dims), unpacked(right, dims), wanted, negatives, least, greatest)

    found = _met(rows, known, sizes, NEGATIVE, below)
    ranked = _first(found, ["anchor", "positive"], "negative_score", "negative_id", "negative", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
