"""Document fingerprints by consistent weighted sampling.

For every term of weight S and every one of ``SAMPLES`` columns, three random
numbers that depend on the term and the column only decide: r and c from a
Gamma(2, 1) distribution and beta, uniform. With ``t = floor(ln S / r + beta)``
and ``ln a = ln c - r * (t - beta + 1)`` the term with the smallest ``a`` is the
column's sample, together with its t. Two texts agree in a column with the
probability of their generalised Jaccard similarity (sum of smaller weights by
sum of larger weights). Terms are lower-cased words, weights their counts. The
random numbers come from three fixed tables, addressed by different bits of the
term's hash. A fingerprint holds ``BITS`` bits of each sample's hash.

``edits`` compares every text with its successor in descending key order. Texts
move once: to parts of the key range whose bounds are keys, so that a part
needs from the next one only the rows of its first key. What is collected is
one bound per part.

A text without words has the fingerprint zero; it is like another such text (1)
and unlike any other (0). Null text is an empty text. Null keys come last, equal
keys in the order of a hash of their texts. Repeated rows follow each other. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import slices

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLES = 128
BITS = 16
TABLE_ROWS = 1 << 14
TERM_BLOCK = 4096
SEED = 2010
ROWS_PER_PART = 20_000
# of the quantiles that cut the parts: a part errs by that share of the rows at most
ACCURACY = 1_000_000


def random_tables(samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta for every table row and column."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    shape = (TABLE_ROWS, samples)

    def uniform() -> np.ndarray:
        return 1.0 - rng.random(shape)

    def gamma() -> np.ndarray:
        return -np.log(uniform() * uniform())

    r = gamma().astype(np.float32)
    log_c = np.log(gamma()).astype(np.float32)
    return r, log_c, rng.random(shape).astype(np.float32)


class Sampler:
    """Fingerprints of texts; holds the tables."""

    def __init__(self, samples: int = SAMPLES) -> None:
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.samples = samples
        self.r, self.log_c, self.beta = random_tables(samples)

    def of_weights(self, weights: dict[str, float]) -> np.ndarray:
        """Samples of a weighted set, as 16-bit hashes; zeros if it is empty."""
        best = np.full(self.samples, np.inf, dtype=np.float32)
        chosen = np.zeros(self.samples, dtype=np.uint64)
        terms = list(weights)
        columns = np.arange(self.samples)
        for start in range(0, len(terms), TERM_BLOCK):
            block = terms[start : start + TERM_BLOCK]
            hashes = np.fromiter(map(self.hash, block), dtype=np.uint64, count=len(block))
            row = (hashes & np.uint64(TABLE_ROWS - 1)).astype(np.intp)
            r = self.r[row]
            beta = self.beta[((hashes >> np.uint64(20)) & np.uint64(TABLE_ROWS - 1)).astype(np.intp)]
            value = self.log_c[((hashes >> np.uint64(40)) & np.uint64(TABLE_ROWS - 1)).astype(np.intp)]
            weight = np.fromiter((weights[t] for t in block), dtype=np.float32, count=len(block))
            t = np.log(weight)[:, None] / r
            t += beta
            np.floor(t, out=t)
            value -= r * (t - beta + 1)
            least = value.argmin(axis=0)
            found = value[least, columns]
            mixed = hashes[least] * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= t[least, columns].astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed *= np.uint64(0xFF51AFD7ED558CCD)
            better = found < best
            best[better], chosen[better] = found[better], mixed[better]
        return (chosen >> np.uint64(64 - BITS)).astype(np.uint16)

    def of_text(self, text: str) -> tuple[bool, np.ndarray]:
        """Whether the text has words, and its samples."""
        weights = Counter(text.lower().split())
        return bool(weights), self.of_weights(weights)


def likeness(a: tuple[bool, np.ndarray], b: tuple[bool, np.ndarray]) -> float:
    if not (a[0] and b[0]):
        return float(a[0] == b[0])
    return float((a[1] == b[1]).mean())


def as_hex(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``fingerprint`` of every row."""
    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            found = [as_hex(sampler.of_text(t.as_py() or "")[1]) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(found, pa.string())], ["key", "fingerprint"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


# ---- successors ----


def _bounds(docs: DataFrame, key: str) -> tuple[list[int], int | None]:
    """Keys that begin a part, descending, and the largest key."""
    total, largest = docs.agg(F.count(F.lit(1)), F.max(docs[f"`{key}`"])).first()
    session = docs.sparkSession
    parts = max(3 * int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_PER_PART))
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(docs[f"`{key}`"], shares, min(20 * parts, ACCURACY))).first()[0]
    return sorted(set(found or []), reverse=True), largest


def _table(bounds: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, bounds)) or "x"), ",").try_cast("array<bigint>")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or above the key, by bisection; null comes last."""
    table = _table(bounds)
    steps = F.sequence(F.lit(0), F.lit(max(len(bounds), 1).bit_length()))

    def halve(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        mid = F.floor((low + high) / 2).cast("int")
        above = F.get(table, mid) >= key
        return F.when(low >= high, range_).otherwise(
            F.struct(F.when(above, mid + 1).otherwise(low).alias("low"), F.when(above, high).otherwise(mid).alias("high"))
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    inside = F.aggregate(steps, start, halve, lambda r: r["low"])
    return F.when(key.isNull(), F.lit(len(bounds))).otherwise(inside if bounds else F.lit(0))


def in_parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``part, guest, key, text`` in partitions that hold whole parts, sorted;
    a guest belongs to the next part (or, after the last, to the first)."""
    bounds, largest = _bounds(docs, key)
    k, body = docs[f"`{key}`"], F.coalesce(docs[f"`{text}`"], F.lit(""))
    first = k.eqNullSafe(F.lit(largest).cast(docs.schema[key].dataType))
    placed = docs.select(k.alias("key"), body.alias("text"), _place(k, bounds).alias("own"), first.alias("first"))
    # the last of the bounds at or above a key is the key itself, or none is
    starts = F.coalesce(F.get(_table(bounds), F.col("own") - 1) == F.col("key"), F.lit(False))
    stays = F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("guest")))
    none = F.array().cast("array<struct<part: int, guest: int>>")
    before = F.when(starts, F.array(F.struct((F.col("own") - 1).alias("part"), F.lit(1).alias("guest")))).otherwise(none)
    wraps = F.when(F.col("first"), F.array(F.struct(F.lit(len(bounds)).alias("part"), F.lit(1).alias("guest")))).otherwise(none)
    dealt = placed.select("key", "text", F.explode(F.concat(stays, before, wraps)).alias("to")).select("to.*", "key", "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(partitions, -(-(len(bounds) + 1) // 3))
    return dealt.repartition(partitions, "part").sortWithinPartitions(
        "part", "guest", F.desc_nulls_last("key"), F.xxhash64("text")
    )


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: length, digest and fingerprint of the edited text (its last half
    replaced by the beginning of the successor), the text's own fingerprint, and
    its likeness to the edited text and to the successor."""
    parts = in_parts(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        waiting = None  # part, key, text, samples of the row whose successor is due
        for batch in slices(batches):
            keys, rows = [], []
            for part, guest, row_key, row_text in zip(
                batch["part"].to_pylist(), batch["guest"].to_pylist(), batch["key"], batch["text"].to_pylist()
            ):
                if guest and (waiting is None or waiting[0] != part):
                    continue
                own = sampler.of_text(row_text)
                if waiting is not None and waiting[0] == part:
                    _, last_key, last, samples = waiting
                    half = len(last) // 2
                    edited = last[: len(last) - half] + row_text[:half]
                    other = samples if edited == last else sampler.of_text(edited)
                    keys.append(last_key)
                    rows.append(
                        (
                            len(last),
                            hashlib.sha256(edited.encode()).hexdigest(),
                            as_hex(samples[1]),
                            as_hex(other[1]),
                            likeness(samples, other),
                            likeness(samples, own),
                        )
                    )
                waiting = None if guest else (part, row_key, row_text, own)
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.as_py() for k in keys], batch["key"].type), *map(pa.array, columns, types)], ["key", *names]
            )

    schema = (
        f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return parts.mapInArrow(run, schema).withColumnRenamed("key", key)
