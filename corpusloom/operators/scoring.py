"""Scores of predicted SQL against gold SQL."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.structure import structure_ok
from corpusloom.functions.text import norm_sql


def score_rows(
    pairs: DataFrame,
    gold: str = "gold",
    pred: str = "pred",
    gate: Callable[[Column], Column] = structure_ok,
) -> DataFrame:
    """Add ``parse_ok`` (what ``gate`` says of the prediction) and ``em``
    (normalised exact match) to aligned rows."""
    return pairs.withColumns({
        "parse_ok": F.coalesce(gate(F.col(pred)), F.lit(False)),
        "em": F.coalesce(norm_sql(F.col(gold)) == norm_sql(F.col(pred)), F.lit(False)),
    })


def score(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates, over all rows or per group; rates are null for n = 0."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("parse_ok").alias("parse_ok"),
        F.count_if("em").alias("em"),
    ).withColumns({
        "parse_rate": F.try_divide("parse_ok", "n"),
        "normalized_em": F.try_divide("em", "n"),
    })


def score_by(
    scored: DataFrame, manifest: DataFrame, keys: Sequence[str], row_id: str = "rec_id"
) -> DataFrame:
    """Scores per group of the manifest, for error analysis. A scored row that
    the manifest does not list, or lists twice, fails the job with its id."""
    listed = manifest.groupBy(row_id).agg(
        F.count(F.lit(1)).alias("_times"), *[F.first(k).alias(k) for k in keys]
    )
    said = F.concat(F.lit("manifest rows for "), F.col(row_id).cast("string"), F.lit(": "),
                    F.coalesce("_times", F.lit(0)).cast("string"))
    once = F.coalesce(F.col("_times") == 1, F.lit(False))
    joined = scored.join(listed, row_id, "left")
    return score(joined.withColumn("em", F.when(once, F.col("em")).otherwise(F.raise_error(said))), keys)


# Replicates of the bootstrap, four per digest of an id, and the share of them
# inside an interval.
REPLICATES = 200
INSIDE = 0.95


def poisson_cuts() -> list[int]:
    """Cumulative probabilities of a Poisson count of mean one, of 2 ** 32."""
    cuts, total, k = [], 0.0, 0
    while int(total * 2**32) < 2**32 - 1 and k < 16:
        total += math.exp(-1) / math.factorial(k)
        cuts.append(int(total * 2**32))
        k += 1
    return cuts


def _weight(digest: Column, part: int) -> Column:
    """How often a replicate takes the row: eight hex digits of the digest."""
    number = F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long")
    return reduce(lambda a, b: a + b, [(number >= cut).cast("int") for cut in poisson_cuts()])


def score_by_tier(
    scored: DataFrame, tier: str, row_id: str = "rec_id", replicates: int = REPLICATES, inside: float = INSIDE
) -> DataFrame:
    """Scores per tier and of all rows (``is_total``), with intervals of both rates
    by a Poisson bootstrap.

    A replicate takes every row a Poisson number of times, which depends on id and
    replicate only, so the intervals are the same for any partitioning. All
    replicates are summed in one aggregation that works before the shuffle; what
    follows sees a row per tier and four replicates. An interval runs between the
    replicates' rates at ``floor((1 - inside) / 2 * m)`` from either end of ``m``.
    """
    parts = range(4)
    digest = F.md5(F.concat(F.col(row_id).cast("string"), F.lit("|"), F.col("block").cast("string")))
    each = scored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))))
    weighed = each.withColumns({f"_w{p}": _weight(digest, p) for p in parts})
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("int")
    sums = []
    for p in parts:
        w = F.col(f"_w{p}")
        sums += [F.sum(w).alias(f"n{p}"), F.sum(w * flag("parse_ok")).alias(f"parse{p}"), F.sum(w * flag("em")).alias(f"em{p}")]
    one = F.when(F.col("block") == 0, 1).otherwise(0)
    plain = [
        F.sum(one).alias("n"), F.sum(one * flag("parse_ok")).alias("parse_ok"), F.sum(one * flag("em")).alias("em"),
    ]
    base = weighed.groupBy(tier, "block").agg(*plain, *sums)
    names = ["n", "parse_ok", "em", *[f"{kind}{p}" for p in parts for kind in ("n", "parse", "em")]]
    rolled = base.groupingSets([[F.col(tier), F.col("block")], [F.col("block")]], F.col(tier), F.col("block")).agg(
        (F.grouping(tier) == 1).alias("is_total"), *[F.sum(c).alias(c) for c in names]
    )
    drawn = F.inline(F.array(*[
        F.struct(
            (F.col("block") * 4 + p).alias("replicate"),
            F.try_divide(F.col(f"parse{p}"), F.col(f"n{p}")).alias("parse_rate"),
            F.try_divide(F.col(f"em{p}"), F.col(f"n{p}")).alias("em_rate"),
        )
        for p in parts
    ]))
    rates = rolled.select(tier, "is_total", "n", "parse_ok", "em", drawn).where(F.col("replicate") < replicates)
    lists = rates.groupBy("is_total", tier).agg(
        *[F.sum(F.when(F.col("replicate") == 0, F.col(c))).alias(c) for c in ("n", "parse_ok", "em")],
        # as many values as there are replicates
        *[F.array_sort(F.collect_list(c)).alias(c) for c in ("parse_rate", "em_rate")],
    )

    def interval(rate: str, name: str) -> list[Column]:
        low = F.floor(F.size(rate) * F.lit((1 - inside) / 2)).cast("int")
        high = F.size(rate) - 1 - low
        return [F.get(rate, low).alias(f"{name}_low"), F.get(rate, high).alias(f"{name}_high")]

    return lists.select(
        tier, "is_total", "n", "parse_ok", "em",
        F.try_divide("parse_ok", "n").alias("parse_rate"), F.try_divide("em", "n").alias("normalized_em"),
        *interval("parse_rate", "parse"), *interval("em_rate", "em"),
    )
