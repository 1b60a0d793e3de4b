"""Whitening of embeddings by a covariance over different vectors.

Every vector becomes integers, ``floor(GRID * c)``. Identical integer vectors are
one group, counted before the shuffle; a group enters the covariance with weight
one or with its count. Tasks add up sums, then centred products (one matrix
product per batch), and only one row per pair of dimensions reaches the driver,
which takes the eigenvectors. Each different vector is whitened once, and the rows
get the result of their group by a join on its digest, hot groups salted.

Sums are exact integers. A component's eigenvector has its largest entry
positive. Components whose eigenvalue is not above ``NEGLIGIBLE`` of the trace have
no variance to divide by and are left out, so a table with one different vector
gives no rows. Rows whose vector is null or has null or non-finite entries are
left out; rows with a null id stay; repeated rows are repeated. Shorter vectors
are filled up with zeros to the longest. ``deviation`` is null where it is beyond 64
bits. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.joins import lookup_join
from corpusloom.sources.staging import stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = 256
COMPONENTS = 4
NEGLIGIBLE = 1e-13
# vectors of a batch that are multiplied at once, in entries
ENTRIES = 1 << 20


def integers(vector: Column) -> Column:
    """The vector on the integer grid; null if it has an entry that is none."""

    def sound(c: Column) -> Column:
        d = c.cast("double")
        return F.coalesce(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), F.lit(False))

    grid = F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("bigint"))
    return F.when(F.forall(vector, sound), grid)


def digest(x: Column) -> Column:
    return F.sha2(F.array_join(x.cast("array<string>"), ",").cast("binary"), 256)


class Model(NamedTuple):
    """Means and components of the fit list."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a column per component
    values: np.ndarray
    trace: float


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The batch's vectors as rows, zeros behind the shorter ones."""
    lists = batch["x"]
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _pieces(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, ENTRIES // max(dims, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _sums(distinct: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Weight and exact sums per dimension of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for piece in _pieces(batches, dims):
            x, w = _vectors(piece, dims), piece["weight"].to_numpy()
            n += int(w.sum())
            # in 64 bits where nothing can be cut off
            safe = float(np.abs(x, dtype=np.float64).max(initial=0)) * float(w.sum()) < 2.0**62
            sums += (w @ x if safe else w.astype(object) @ x.astype(object)).astype(object)
        places = pa.array(range(-1, dims), pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array([str(v) for v in (n, *sums)])], ["i", "v"])

    total = distinct.select("x", "weight").mapInArrow(run, "i int, v string").groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    )
    # a row per dimension
    found = {r["i"]: int(r["v"]) for r in total.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def _covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list, divisor ``n``, centred before multiplying."""
    dims = len(sums)
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for piece in _pieces(batches, dims):
            centred = _vectors(piece, dims) - mean
            total += centred.T @ (centred * piece["weight"].to_numpy()[:, None])
        i, j = (pa.array(u.astype(np.int32)) for u in upper)
        yield pa.RecordBatch.from_arrays([i, j, pa.array(total[upper])], ["i", "j", "v"])

    total = distinct.select("x", "weight").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    matrix = np.zeros((dims, dims))
    # a row per pair of dimensions
    for r in total.collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["v"] / n
    return matrix


def groups(rows: DataFrame, vector: str, weight: str = "one") -> DataFrame:
    """``group, x, weight``: each different integer vector once. Staged.
    ``weight`` is ``one``, or ``count`` for the number of rows."""
    x = integers(rows[f"`{vector}`"])
    kept = rows.select(x.alias("x")).where(F.col("x").isNotNull()).withColumn("group", digest(F.col("x")))
    counted = kept.groupBy("group").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    given = F.col("n") if weight == "count" else F.lit(1).cast("bigint")
    return stage(counted.select("group", "x", given.alias("weight")))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The first components of the fit list; ``None`` without vectors."""
    dims = distinct.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    n, sums = _sums(distinct, dims)
    matrix = _covariance(distinct, n, sums)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(matrix))
    kept = int((values[:components] > NEGLIGIBLE * trace).sum()) if trace > 0 else 0
    vectors = vectors[:, :kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    return Model(n, sums, vectors * signs, values[:kept], trace)


def project(distinct: DataFrame, model: Model) -> DataFrame:
    """``group, weight, deviation, whitened`` of each different vector. Staged."""
    n, dims = model.n, len(model.sums)
    sums, mean = np.array(model.sums, object), np.array([s / n for s in model.sums])
    basis = model.vectors / np.sqrt(model.values)
    largest = max(map(abs, model.sums), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        most = float(np.abs(x, dtype=np.float64).max(initial=0)) * n + largest
        if most < 2.0**62 and most * most * dims < 2.0**62:
            spread = n * x - sums.astype(np.int64)
            return (spread * spread).sum(axis=1).tolist()
        spread = n * x.astype(object) - sums
        exact = (spread * spread).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, dims):
            x = _vectors(piece, dims)
            white = (x - mean) @ basis
            yield pa.RecordBatch.from_arrays(
                [piece["group"], piece["weight"], pa.array(deviations(x), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                ["group", "weight", "deviation", "whitened"],
            )

    return stage(distinct.mapInArrow(run, "group string, weight bigint, deviation bigint, whitened array<double>"))


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the
    identity."""
    n = F.sum("weight")
    mean = white.agg(*[F.sum(F.col("weight") * F.col("whitened")[i]) / n for i in range(components)]).first()
    centred = [F.col("whitened")[i] - F.lit(mean[i]) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = white.agg(*[F.sum(F.col("weight") * centred[i] * centred[j]) / n for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weight: str = "one"
) -> DataFrame:
    """Per row and component: ``key, component, n, deviation, whitened,
    explained, identity_error``."""
    schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    distinct = groups(rows, vector, weight)
    model = fit(distinct, components)
    if model is None or not len(model.values):
        none = rows.select(rows[f"`{key}`"].alias("key")).limit(0)
        columns = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))]
        return none.select(F.col("key").alias(key), *columns)
    kept = len(model.values)
    white = project(distinct, model)
    error = identity_error(white, kept)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    x = integers(rows[f"`{vector}`"])
    given = rows.select(rows[f"`{key}`"].alias("key"), x.alias("x")).where(F.col("x").isNotNull())
    # never broadcast: there may be as many groups as rows
    joined = lookup_join(
        given.select("key", digest(F.col("x")).alias("group")), white.drop("weight"), ["group"], staged=True, fits=False
    )
    return joined.select(F.col("key"), "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        F.col("key").alias(key),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("i")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
