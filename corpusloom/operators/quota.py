"""Quota sampling by bucket under a cap per group that all buckets share.

The rule is greedy and sequential: buckets in priority order, rows of a bucket
in shuffle order, rows of a full group skipped, until the quota is met; then a
top-up from the rest of the pool by the same rule. It touches few rows:

- a row with ``cap`` rows of its group before it is never reached, neither in
  its bucket nor by the top-up;
- a row that is skipped has its group's room used up by an earlier pick, and no
  pick does that to more than one row. So a bucket needs no more than its quota
  plus all earlier quotas, and the top-up no more rows than it fills up to.

These heads are found in one pass, by limits that work before the shuffle. The
sequence then runs over them in one task, whose rows the quotas bound, however
large the pool is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from functools import cached_property, reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators import ordering
from corpusloom.operators.joins import BROADCAST_ROWS, lookup_join
from corpusloom.operators.ordering import rank_thresholds
from corpusloom.sources.staging import stage

# executors get the function below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Default quotas, in priority order.
QUOTAS = {
    "set_op": 50,
    "nested": 90,
    "having": 70,
    "multi_join": 100,
    "group_by": 80,
    "single_join": 60,
    "single_table_analytic": 50,
    "simple": 0,
}
PER_GROUP_CAP = 12
SIZE = 500


def greedy_picks(
    rows: list[tuple], quotas: Mapping[str, int], cap: int, size: int | None
) -> list[tuple]:
    """(id, pass) in pick order for (pass, id, group) rows in shuffle order;
    ``quotas`` holds the quota of each bucket's pass, None stands for the top-up."""
    used: dict[object, int] = {}
    picks: dict[object, int] = {}
    by_pass: dict[int, list[tuple]] = {}
    for number, row_id, group in rows:
        by_pass.setdefault(number, []).append((row_id, group))
    wanted = [q for q in quotas.values() if q > 0]
    if size is not None and size > 0:
        wanted.append(None)
    for number, quota in enumerate(wanted):
        room = size - len(picks) if quota is None else quota
        for row_id, group in by_pass.get(number, ()):
            if room <= 0:
                break
            if row_id not in picks and used.get(group, 0) < cap:
                picks[row_id] = number
                used[group] = used.get(group, 0) + 1
                room -= 1
    return list(picks.items())


class QuotaSample:
    """Picks of ``quota_fill`` and ``top_up``.

    ``picks`` has the pool's columns plus ``pick_pass``; pick order is
    (``pick_pass``, ``shuffle_key``, id).
    """

    def __init__(
        self, pool: DataFrame, quotas: Mapping[str, int], group: str, cap: int, bucket: str, row_id: str
    ):
        self.pool, self.quotas, self.cap = pool, quotas, cap
        self.group, self.bucket, self.row_id = group, bucket, row_id
        self.up_to: int | None = None

    def top_up(self, n: int) -> "QuotaSample":
        """Fill up to ``n`` rows from the rest of the pool, cap still on."""
        more = QuotaSample(self.pool, self.quotas, self.group, self.cap, self.bucket, self.row_id)
        more.up_to = n
        return more

    def _heads(self) -> DataFrame:
        """``pass, id, group`` and order of all rows the sequence can touch."""
        names = {"_bucket": self.bucket, "_group": self.group, "shuffle_key": "shuffle_key", "_id": self.row_id}
        narrow = stage(self.pool.select(*[F.col(old).alias(new) for new, old in names.items()]))
        need, before = {}, 0
        for name, quota in self.quotas.items():
            if quota > 0:
                before += quota
                need[name] = (len(need), before)
        parts = []
        if need:
            reachable = within_cap(narrow, "_group", self.cap, "_bucket", "_id")
            wanted = reachable.where(F.col("_bucket").isin(list(need)))
            first = _first_rows(wanted, "_bucket", before, "_id")
            number = _by_name({name: at for name, (at, _) in need.items()}, F.col("_bucket"))
            enough = _by_name({name: rows for name, (_, rows) in need.items()}, F.col("_bucket"))
            parts.append(first.where(F.col("_nth") <= enough).withColumn("_pass", number))
        if self.up_to:
            everywhere = narrow.withColumn("_bucket", F.lit(""))
            reachable = within_cap(everywhere, "_group", self.cap, "_bucket", "_id")
            first = _first_rows(reachable, "_bucket", max(self.up_to, before), "_id")
            parts.append(first.withColumn("_pass", F.lit(len(need))))
        columns = ("_pass", "shuffle_key", "_id", "_group")
        if not parts:
            return narrow.select(F.lit(0).alias("_pass"), *columns[1:]).limit(0)
        return reduce(DataFrame.union, [part.select(*columns) for part in parts])

    def state(self) -> DataFrame:
        """The rows the sequence can touch, staged: all of a pool that a later
        sample over it and appended rows needs, and no more than the quotas bound.

        What is before a row only grows when rows are appended, so a row that is
        out of reach stays so. The state of a union is the state of the old state
        and the new rows, and so are the picks.
        """
        ids = self._heads().select(F.col("_id").alias(self.row_id)).distinct()
        return stage(lookup_join(self.pool, ids, [self.row_id], "left_semi"))

    @cached_property
    def picks(self) -> DataFrame:
        quotas, cap, size = self.quotas, self.cap, self.up_to
        heads = self._heads().repartition(1).sortWithinPartitions("_pass", "shuffle_key", "_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, kind = [], None
            for batch in batches:
                kind = batch["_id"].type
                rows += zip(*[batch[c].to_pylist() for c in ("_pass", "_id", "_group")])
            if rows:
                ids, passes = zip(*found) if (found := greedy_picks(rows, quotas, cap, size)) else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), pa.array(passes, pa.int32())], ["_id", "pick_pass"]
                )

        kind = self.pool.schema[self.row_id].dataType.simpleString()
        chosen = stage(heads.mapInArrow(run, f"_id {kind}, pick_pass int"))
        # no more rows than the quotas ask for
        bound = sum(self.quotas.values()) + (self.up_to or 0)
        small = F.broadcast(chosen) if bound <= BROADCAST_ROWS else chosen
        joined = self.pool.join(small, F.col(self.row_id) == F.col("_id")).drop("_id")
        return stage(joined.select(*self.pool.columns, "pick_pass"))

    @property
    def size(self) -> int:
        return self.picks.count()

    def head(self, n: int) -> DataFrame:
        """The first ``n`` picks in pick order."""
        return self.picks.orderBy("pick_pass", "shuffle_key", self.row_id).limit(n)


def _by_name(values: Mapping[str, int], name: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def _first_rows(rows: DataFrame, of: str, n: int, row_id: str) -> DataFrame:
    """The first ``n`` rows of each value of ``of`` in shuffle order, with their
    place ``_nth``. The limit works before the shuffle or, for a large ``n``, by
    the row at the cut, so that no task ranks much more than ``n`` rows."""
    limit = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit:
        rows = stage(rows)
        cuts = rank_thresholds(rows, [of], {"_last": lambda size: F.lit(n)}, row_id)
        marked = lookup_join(rows, cuts, [of], "left", staged=True)
        rows = marked.where(F.struct("shuffle_key", row_id) <= F.col("_last")).drop("_last")
    in_order = Window.partitionBy(of).orderBy("shuffle_key", row_id)
    return rows.withColumn("_nth", F.row_number().over(in_order)).where(F.col("_nth") <= n)


def _cut_large_groups(
    pool: DataFrame, keys: list[str], cap: int, row_id: str
) -> DataFrame:
    """Drop what lies beyond the cap in groups too large for one task to rank.

    Up to a certain cap the window limits each group to ``cap`` rows per task
    before the shuffle; if that bounds a group well enough, nothing is to do.
    """
    limit = pool.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    if cap <= int(limit):
        return pool
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > ordering.ROWS_PER_CELL).select(*keys)
    if large.isEmpty():
        return pool
    narrow = stage(lookup_join(pool.select(*keys, "shuffle_key", row_id), large, keys))
    cuts = rank_thresholds(narrow, keys, {"_last": lambda n: F.lit(cap)}, row_id)
    inside = F.struct("shuffle_key", row_id) <= F.col("_last")
    marked = lookup_join(pool, cuts, keys, "left", staged=True)
    return marked.where(F.coalesce(inside, F.lit(True))).drop("_last")


def within_cap(
    pool: DataFrame, group: str, cap: int, bucket: str = "bucket", row_id: str = "rec_id"
) -> DataFrame:
    """Rows that can be picked at all, with their rank in (bucket, group).

    A row with ``cap`` or more rows of its group and bucket before it is never
    reached, not even by the top-up: each of those rows was either picked,
    which uses the cap up, or still comes first.
    """
    rows = _cut_large_groups(pool, [bucket, group], cap, row_id)
    in_bucket = Window.partitionBy(bucket, group).orderBy("shuffle_key", row_id)
    return rows.withColumn("rank_in_bucket", F.row_number().over(in_bucket)).where(
        F.col("rank_in_bucket") <= cap
    )


def quota_fill(
    pool: DataFrame,
    quotas: Mapping[str, int] = QUOTAS,
    group: str = "db_id",
    cap: int = PER_GROUP_CAP,
    bucket: str = "bucket",
    row_id: str = "rec_id",
) -> QuotaSample:
    """Fill the quotas in the order given.

    ``pool`` needs a ``shuffle_key``. It is read twice, so stage it if it is
    expensive to compute.
    """
    return QuotaSample(pool, quotas, group, cap, bucket, row_id)


def fill_counts(picks: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Number of picks per bucket."""
    return picks.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
