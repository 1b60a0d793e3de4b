"""Seeded order, and exact ranks in it without sorting a large group.

The shuffle key of a row is the MD5 of seed and id, so the order is the same
for any partitioning. Its leading hex digits divide a group into cells of
nearly equal size whatever the data looks like. A histogram over the cells
tells in which cell a rank falls, and only that cell is sorted. Small groups
are one cell; a group that holds a third of a huge table has up to 65,536, so
no task ever ranks much more than ``ROWS_PER_CELL`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.joins import lookup_join, measured
from corpusloom.sources.staging import stage

ROWS_PER_CELL = 1_000_000
MAX_CELL_DIGITS = 4
# Up to this many rows orderBy().limit() merges the heads of all partitions.
SMALL_LIMIT = 1_000


def shuffle_key(seed: int, row_id: str | Column) -> Column:
    """Hex digest that orders rows at random but reproducibly."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")
                          if isinstance(row_id, str) else row_id.cast("string")))


def with_shuffle_key(df: DataFrame, seed: int, row_id: str = "rec_id") -> DataFrame:
    return df.withColumn("shuffle_key", shuffle_key(seed, row_id))


def _cell_digits(size: Column) -> Column:
    """Digits that keep the cells of a group of this size small."""
    steps = [(size <= ROWS_PER_CELL * 16**d, F.lit(d)) for d in range(MAX_CELL_DIGITS)]
    return reduce(lambda chain, step: chain.when(*step), steps, F).otherwise(MAX_CELL_DIGITS)


def rank_thresholds(
    rows: DataFrame,
    groups: Sequence[str],
    cuts: Mapping[str, Callable[[Column], Column]],
    row_id: str = "rec_id",
) -> DataFrame:
    """The row at each cut of each group's shuffle order.

    ``rows`` is read several times and should be a table that is cheap to read.
    ``cuts`` maps a name to a function from the group size to the number of
    leading rows wanted. Returns a staged table with one row per group and per
    cut name a ``(shuffle_key, id)`` struct: exactly the rows up to it are
    inside the cut. It is null where a cut wants no rows.
    """
    narrow = rows.select(*groups, "shuffle_key", row_id)
    sizes = stage(narrow.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size")))
    sizes_fit, largest = measured(sizes, F.max("_size"))
    size = F.col("_size")
    celled = lookup_join(narrow, sizes, groups, staged=True, fits=sizes_fit).withColumn(
        "_cell", F.substring("shuffle_key", F.lit(1), _cell_digits(size))
    )

    one_cell = sizes.where(size <= ROWS_PER_CELL).select(
        *groups, "_size", F.lit("").alias("_cell"), size.alias("_n"), size.alias("_upto")
    )
    has_large = (largest or 0) > ROWS_PER_CELL
    if has_large:
        running = Window.partitionBy(*groups).orderBy("_cell")
        many_cells = (
            celled.where(size > ROWS_PER_CELL)
            .groupBy(*groups, "_size", "_cell")
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_upto", F.sum("_n").over(running))
        )
        one_cell = one_cell.unionByName(many_cells)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("cut"), F.least(want(size), size).alias("rank"))
        for name, want in cuts.items()
    ])
    before = F.col("_upto") - F.col("_n")
    # at most one cell per group and cut holds the row at the cut
    edges = one_cell.select(
        *groups, "_cell", before.alias("_before"),
        F.filter(
            wanted, lambda c: (c["rank"] > before) & (c["rank"] <= F.col("_upto"))
        ).alias("_edge"),
    ).where(F.size("_edge") > 0)
    edges = stage(edges) if has_large else edges

    in_cell = Window.partitionBy(*groups, "_cell").orderBy("shuffle_key", row_id)
    hits = (
        lookup_join(
            celled, edges, [*groups, "_cell"], staged=True, fits=None if has_large else sizes_fit
        )
        .withColumn("_rn", F.row_number().over(in_cell) + F.col("_before"))
        .select(*groups, F.inline("_edge"), "_rn", F.struct("shuffle_key", row_id).alias("_at"))
        .where(F.col("_rn") == F.col("rank"))
    )
    return stage(hits.groupBy(*groups).agg(
        *[F.max(F.when(F.col("cut") == name, F.col("_at"))).alias(name) for name in cuts]
    ))


def label_by_rank(
    rows: DataFrame,
    groups: Sequence[str],
    cuts: Mapping[str, Callable[[Column], Column]],
    rest: str,
    row_id: str = "rec_id",
    out: str = "label",
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Label each row with the first cut it is inside of, or ``rest``.

    The ranks are found on a narrow table of groups, shuffle key and id, which
    is staged from ``rows`` unless ``narrow`` supplies it. The wide rows are only
    passed through a broadcast join, never shuffled or sorted.
    """
    if narrow is None:
        narrow = stage(rows.select(*groups, "shuffle_key", row_id))
    thresholds = rank_thresholds(narrow, groups, cuts, row_id)
    return label_by_thresholds(rows, groups, thresholds, rest, row_id, out)


def label_by_thresholds(
    rows: DataFrame,
    groups: Sequence[str],
    thresholds: DataFrame,
    rest: str,
    row_id: str = "rec_id",
    out: str = "label",
    fits: bool | None = None,
) -> DataFrame:
    """Label each row with the first of the ``rank_thresholds`` it is not beyond."""
    cuts = [name for name in thresholds.columns if name not in groups]
    at = F.struct("shuffle_key", row_id)
    label = reduce(
        lambda chain, name: chain.when(at <= F.col(f"_at_{name}"), name), cuts, F
    ).otherwise(rest)
    renamed = thresholds.withColumnsRenamed({name: f"_at_{name}" for name in cuts})
    joined = lookup_join(rows, renamed, groups, "left", staged=True, fits=fits)
    return joined.withColumn(out, label).drop(*[f"_at_{name}" for name in cuts])


def take_first(rows: DataFrame, k: int, row_id: str = "rec_id") -> DataFrame:
    """The first ``k`` rows in shuffle order."""
    if k <= SMALL_LIMIT:
        return rows.orderBy("shuffle_key", row_id).limit(k)
    constant = rows.withColumn("_all", F.lit(0))
    labelled = label_by_rank(constant, ["_all"], {"in": lambda n: F.lit(k)}, "out",
                             row_id, "_side")
    return labelled.where(F.col("_side") == "in").drop("_side", "_all")


def head(df: DataFrame, n: int, order_by: str = "ord") -> DataFrame:
    """The first ``n`` rows of the input, for samples and previews.

    The position of the last one is looked up first. As a plain filter it
    reaches the scan, which then skips nearly all of the wide columns.
    """
    last = df.select(order_by).orderBy(order_by).limit(n).agg(F.max(order_by)).first()[0]
    return df.where(F.col(order_by) <= F.lit(last)).orderBy(order_by).limit(n)


def with_position(
    rows: DataFrame, major: str, row_id: str = "rec_id", out: str = "position"
) -> DataFrame:
    """Dense 0-based position in the order (``major``, shuffle key, id).

    ``major`` must have few values (a split rank). Every cell is ranked by
    itself and shifted by the number of rows before it.
    """
    fine = stage(
        rows.groupBy(major, F.substring("shuffle_key", 1, MAX_CELL_DIGITS).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    total = fine.agg(F.sum("_n")).first()[0] or 0
    digits = next(
        (d for d in range(1, MAX_CELL_DIGITS) if total <= ROWS_PER_CELL * 16**d), MAX_CELL_DIGITS
    )
    cells = fine.groupBy(major, F.substring("_cell", 1, digits).alias("_cell")).agg(
        F.sum("_n").alias("_n")
    )
    celled = rows.withColumn("_cell", F.substring("shuffle_key", 1, digits))
    majors = cells.groupBy(major).agg(F.sum("_n").alias("_n_major"))
    # both running sums are over a few values, at most 16^digits per value of major
    before_major = F.sum("_n_major").over(Window.orderBy(major)) - F.col("_n_major")
    before_cell = F.sum("_n").over(Window.partitionBy(major).orderBy("_cell")) - F.col("_n")
    shifts = (
        cells.withColumn("_before", before_cell)
        .join(majors.withColumn("_before_major", before_major), major)
        .select(major, "_cell", (F.col("_before") + F.col("_before_major")).alias("_shift"))
    )
    in_cell = Window.partitionBy(major, "_cell").orderBy("shuffle_key", row_id)
    ranked = celled.withColumn("_rn", F.row_number().over(in_cell))
    # at most 16^digits rows per value of major
    return (
        lookup_join(ranked, shifts, [major, "_cell"], staged=True, fits=True)
        .withColumn(out, F.col("_shift") + F.col("_rn") - 1)
        .drop("_shift", "_rn", "_cell")
    )


def _targets(major: str, sizes: Mapping[int, int], partitions: int) -> tuple[Column, int]:
    """The partition of a row in the order (``major``, shuffle key), and their
    number. Keys are uniform, so their leading digits give the partition."""
    total = max(sum(sizes.values()), 1)
    digits = 6
    place = F.conv(F.substring("shuffle_key", 1, digits), 16, 10).cast("long")
    target, start = F, 0
    for value, n in sorted(sizes.items()):
        width = -(-partitions * n // total)
        target = target.when(
            F.col(major) == value, F.lit(start) + F.shiftright(place * width, 4 * digits)
        )
        start += width
    return target.cast("int") if sizes else F.lit(0), start


def in_order(
    rows: DataFrame, major: str, sizes: Mapping[int, int], partitions: int
) -> DataFrame:
    """Move rows so that partitions follow the order (``major``, shuffle key).

    A range partitioning would read its whole input once more to sample it; the
    partition is computed from the key instead. ``sizes`` holds the number of
    rows per value of ``major``.
    """
    target, n = _targets(major, sizes, partitions)
    return rows if not sizes else rows.repartitionById(n, target)


def rows_before(
    rows: DataFrame, major: str, sizes: Mapping[int, int], partitions: int
) -> DataFrame:
    """``_target, _ahead`` for rows that ``in_order`` will move: how many rows the
    partitions before hold. One row per partition, no other row is moved."""
    target, _ = _targets(major, sizes, partitions)
    counts = rows.groupBy(target.alias("_target")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_target")) - F.col("_n")
    return stage(counts.select("_target", ahead.alias("_ahead")))


def with_running_position(
    ranged: DataFrame, ahead: DataFrame, out: str = "position"
) -> DataFrame:
    """Dense 0-based position of rows that lie in order in their partitions."""
    marked = ranged.withColumns({
        "_target": F.spark_partition_id(),
        # the lower bits count the rows of a partition
        "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    # as many rows as there are partitions
    joined = marked.join(F.broadcast(ahead), "_target")
    return joined.withColumn(out, F.col("_ahead") + F.col("_nth")).drop("_target", "_nth", "_ahead")
