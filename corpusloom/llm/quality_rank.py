"""Quality scores by Bradley-Terry ranking of preference pairs.

A document is a short vector of built-in text statistics. In the
Bradley-Terry model the better one of a pair wins with probability
``sigmoid(w . (x_better - x_worse))``; w is fitted by logistic loss on such
differences. The threshold is the quantile of the training scores that equals
the share of label 0, and the published score is shifted so that this quantile
is ``THRESHOLD``.

Every labelled document trains. They are dealt by the hash of the id to blocks of
about ``BLOCK`` documents of the more frequent label; those of the rarer one go
to several blocks if there are too few of them to give each block ``MATES``.
Inside a block every document of either label meets partners from the other, in
``PAIRS`` pairs, so the number of pairs grows with the labels. A step of the fit
sums loss and curvature in the blocks, the driver gets the sums alone. The
threshold is an exact order statistic, found by counting cells that narrow
around it. Mean, spread and the sums of a step add up integers, so the same
labels give the same weights however the tables are laid out.

The vectors are computed once, if the caller hands those of ``vectors_of`` to
both ``train`` and ``scored``. Scoring is one expression over all documents: no
shuffle, no Python.

Null, empty and blank texts have an all-zero vector of counts and are scored
like any text. Repeated rows score alike. Labels that are null are left out; of
several labels of one id the largest counts. Without labels of both kinds all
scores are 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import let, words
from corpusloom.sources.staging import stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096
MATES = 64
# pairs of a block, if it has as many
PAIRS = 100_000
RIDGE = 1.0
THRESHOLD = 0.7
SEED = 11
# sums are of multiples of this
UNIT = 2.0**-32
# cells of one pass of the search for a quantile
CELLS = 1024


def features(text: Column) -> Column:
    """The vector of one text."""
    body = F.coalesce(text, F.lit(""))

    def signs(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern)).cast("double")

    def vector(w: Column) -> Column:
        n = F.size(w).cast("double")
        each = F.greatest(n, F.lit(1.0))
        chars = F.greatest(F.length(F.array_join(w, "")).cast("double"), F.lit(1.0))
        distinct = F.size(F.array_distinct(w)).cast("double")
        lines = F.split(body, "\n")
        same_lines = let(lines, lambda x: 1 - F.size(F.array_distinct(x)) / F.size(x))

        def share(value: Column) -> Column:
            return F.least(value, F.lit(1.0))

        return F.array(
            F.log1p(n),
            share(signs("[#*$%&<>]") / each),
            share(2 * signs("\\|") / each),
            share(signs("!") / each),
            signs("\\p{Lu}") / chars,
            signs("[0-9]") / chars,
            distinct / each,
            # few different words for the length: a repeated passage
            F.log1p(n) - F.log1p(distinct),
            same_lines,
            F.least(chars / each, F.lit(20.0)),
            share(signs("[.,;:]") / each),
        )

    return let(words(body), vector)


@dataclass(frozen=True)
class Ranking:
    """Weights, offset and spread of the features, and the raw threshold."""

    weight: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    cut: float

    def raw(self, vector: Column) -> Column:
        slope = [w / s for w, s in zip(self.weight, self.spread)]
        base = -sum(w * m for w, m in zip(slope, self.mean))
        raw = F.lit(base)
        for i, w in enumerate(slope):
            raw = raw + F.lit(w) * vector[i]
        return raw

    def score(self, vector: Column) -> Column:
        raw = self.raw(vector)
        return 1 / (1 + F.exp(-(raw - F.lit(self.cut) + F.lit(math.log(THRESHOLD / (1 - THRESHOLD))))))


def pair_differences(x: np.ndarray, better: np.ndarray, rng: np.random.Generator, pairs: int = PAIRS) -> np.ndarray:
    """Differences better minus worse; each document of either kind takes part
    about equally often."""
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    n = min(pairs, len(good) * len(bad))

    def spread(of: np.ndarray) -> np.ndarray:
        rounds = -(-n // len(of))
        return np.concatenate([rng.permutation(of) for _ in range(rounds)])[:n]

    return x[spread(good)] - x[spread(bad)]


Sums = tuple[np.ndarray, np.ndarray]


def loss_sums(differences: np.ndarray, w: np.ndarray) -> Sums:
    """Gradient and curvature of the logistic loss, without the ridge."""
    p = 1 / (1 + np.exp(-np.clip(differences @ w, -500, 500)))
    return differences.T @ (1 - p), (differences * (p * (1 - p))[:, None]).T @ differences


def newton(sums: Callable[[np.ndarray], Sums], n: int, ridge: float = RIDGE) -> np.ndarray:
    """The ``n`` weights at which the sums and the ridge are least."""
    w = np.zeros(n)
    for _ in range(50):
        gradient, curve = sums(w)
        step = np.linalg.solve(curve + ridge * np.eye(n), gradient - ridge * w)
        # a long step can overshoot where the curve is flat
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pairs(differences: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the logistic loss of the differences (Newton)."""
    return newton(lambda w: loss_sums(differences, w), differences.shape[1], ridge)


# ---- training over a table ----


def vectors_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, x``: key and vector of every row. Staged."""
    return stage(docs.select(docs[f"`{key}`"].alias("k"), features(docs[f"`{text}`"]).alias("x")))


def _sum(value: Column) -> Column:
    """A sum in units, which does not depend on the order of the rows."""
    return F.sum(F.rint(value / F.lit(UNIT)).cast("decimal(38,0)"))


def _means(rows: DataFrame, values: list[Column], n: int) -> np.ndarray:
    totals = rows.agg(*[_sum(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
    return np.array([float(t) * UNIT / n for t in totals])


def moments(rows: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of every entry of ``x``."""
    entries = [F.col("x")[i] for i in range(width)]
    mean = _means(rows, entries, n)
    spread = np.sqrt(_means(rows, [F.pow(e - F.lit(float(m)), F.lit(2.0)) for e, m in zip(entries, mean)], n))
    spread[spread < 1e-9] = 1.0
    return mean, spread


def blocks_of(rows: DataFrame, n: int, good: int) -> DataFrame:
    """``block, better, x``: labels and vectors (one after the other) of each
    block's documents, by key. Staged."""
    fewer = min(good, n - good)
    blocks = -(-(n - fewer) // BLOCK)
    copies = min(blocks, -(-blocks * MATES // fewer))
    rarer = F.col("better") == F.lit(good == fewer)
    more = F.when(rarer, F.lit(copies - 1)).otherwise(F.lit(0))
    first = F.pmod(F.xxhash64("k"), F.lit(blocks))
    places = F.transform(F.sequence(F.lit(0), more), lambda i: (first + i) % blocks)
    dealt = rows.select("k", "better", "x", F.explode(places).alias("block"))
    # a block is bounded by BLOCK and the share of the other label
    members = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "better", "x"))).alias("m"))
    return stage(members.select(
        "block", F.transform("m", lambda r: r["better"]).alias("better"),
        F.flatten(F.transform("m", lambda r: r["x"])).alias("x"),
    ))


def block_sums(blocks: DataFrame, mean: np.ndarray, spread: np.ndarray) -> Callable[[np.ndarray], Sums]:
    """The sums of a step over the pairs of all blocks."""
    n = len(mean)

    def sums(w: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, better, x in zip(batch["block"], batch["better"], batch["x"]):
                    kind = better.values.to_numpy(zero_copy_only=False)
                    if kind.all() or not kind.any():
                        continue
                    z = (x.values.to_numpy().reshape(-1, n) - mean) / spread
                    rng = np.random.default_rng([SEED, block.as_py()])
                    gradient, curve = loss_sums(pair_differences(z, kind, rng), w)
                    amounts = np.rint(np.concatenate([gradient, curve.ravel()]) / UNIT)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(range(len(amounts)), pa.int32()),
                            pa.array([Decimal(int(a)) for a in amounts], pa.decimal128(38, 0)),
                        ],
                        ["place", "amount"],
                    )

        parts = blocks.mapInArrow(run, "place int, amount decimal(38,0)")
        found = np.zeros(n + n * n)
        for r in parts.groupBy("place").agg(F.sum("amount").alias("amount")).collect():
            found[r["place"]] = float(r["amount"]) * UNIT
        return found[:n], found[n:].reshape(n, n)

    return sums


def quantile(values: DataFrame, n: int, q: float) -> float:
    """Exact quantile of the ``n`` numbers in the column ``v``, linear between
    neighbours. Each pass counts the cells of the interval that holds it."""
    place = (n - 1) * q
    rank, part = int(place), place - int(place)
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = high / CELLS - low / CELLS
        cell = F.floor((F.col("v") - F.lit(low)) / F.lit(width)) if width else F.lit(0)
        inside = values.where(F.col("v").between(low, high)).withColumn("cell", F.when(
            F.col("v") == F.lit(low), F.lit(-1)).when(F.col("v") == F.lit(high), F.lit(CELLS + 1)).otherwise(cell)
        )
        # at most CELLS + 3 rows, in order of their values
        for r in inside.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        ).orderBy("low").collect():
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    if not part:
        return low
    after = values.agg(F.count_if(F.col("v") <= low).alias("n"), F.min(F.when(F.col("v") > low, F.col("v"))).alias("v")).first()
    return low if after["n"] > int(place) + 1 else low + (after["v"] - low) * part


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, may_learn: Column,
    vectors: DataFrame | None = None,
) -> Ranking | None:
    """Fit on the labelled documents for which ``may_learn`` (of the label's
    key) holds; None without two kinds of labels. ``vectors`` are those of
    ``vectors_of``, if there are any yet."""
    known = labels.where(may_learn & labels[label].isNotNull() & labels[key].isNotNull())
    known = known.groupBy(known[key].alias("k")).agg((F.max(label) == 1).alias("better"))
    vectors = vectors_of(docs, key, text) if vectors is None else vectors
    # one vector per label, however often its id occurs
    rows = stage(vectors.groupBy("k").agg(F.min("x").alias("x")).join(known, "k").select("k", "better", "x"))
    n, good, width = rows.agg(F.count(F.lit(1)), F.count_if("better"), F.max(F.size("x"))).first()
    if good in (0, n):
        return None
    mean, spread = moments(rows, n, width)
    w = newton(block_sums(blocks_of(rows, n, good), mean, spread), width)
    ranking = Ranking(*(tuple(map(float, v)) for v in (w, mean, spread)), 0.0)
    scores = rows.select(ranking.raw(F.col("x")).alias("v"))
    return replace(ranking, cut=quantile(scores, n, 1 - good / n))


def scored(
    docs: DataFrame, key: str, text: str, ranking: Ranking | None, vectors: DataFrame | None = None
) -> DataFrame:
    """``key, score, predicted`` per row; ``vectors`` as in ``train``."""
    if vectors is None:
        keys, vector = docs[f"`{key}`"], features(docs[f"`{text}`"])
    else:
        docs, keys, vector = vectors, vectors["k"], vectors["x"]
    score = F.lit(0.5) if ranking is None else let(vector, ranking.score)
    rows = docs.select(keys.alias(key), score.alias("score"))
    return rows.select(key, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
