"""Mix sources to target weights by Efraimidis-Spirakis sampling.

*Targets.* The sources, in code point order with null last, weigh ``WEIGHTS``
over and over and share the words of the whole table. A target stops at
``MAX_EPOCHS`` times its source's words; what is above goes to the others by
weight until none is above. That is one water level L with ``target =
min(cap, weight * L)``: sorted by ``cap / weight`` the capped sources form a
prefix, so running sums find L. One row per source takes part.

*Draw.* A target takes complete epochs of its source first. The rest goes to
the documents with the smallest exponential keys ``-ln(u) / quality``; ``u`` is
a hash of the id, so reruns and lost executors agree. The documents of a source
are taken in key order up to the budget (the one at the boundary if more than
half of it fits), which needs a running sum in key order. A hot source is not
sorted for it: keys fall into cells, the words per cell give the cell in which
the budget ends, and only that cell's documents are ranked.

Null or blank text has size 0 and nothing to take. A source of size 0 has
target 0. Repeated rows and equal ids have equal keys; they are ordered by
size, so the outcome does not depend on their order. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import MATCH, let, matching, packed, unit_hash, words
from corpusloom.sources.staging import stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
CELLS = 1 << 14
MIN_QUALITY = 0.1


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """1 for text without markup signs, less with every sign per word."""
    signs = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0))
    return F.greatest(F.lit(MIN_QUALITY), 1 / (1 + signs / F.greatest(size, F.lit(1))))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` to ``target``. One row per source is ranked by a
    window without partitions."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = sizes.withColumn("weight", cycle[(F.row_number().over(order) - 1) % len(WEIGHTS)])
    weighed = weighed.withColumn("cap", F.lit(float(MAX_EPOCHS)) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    # the level if all sources before this one are capped; the first source
    # that stays below its cap there fixes it
    level = level.withColumn("try", (F.col("total") - F.col("capped")) / F.col("open"))
    below = F.when(F.col("try") * F.col("weight") <= F.col("cap"), F.col("try"))
    level = level.withColumn("level", F.first(below, ignorenulls=True).over(
        rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.least("cap", F.col("weight") * F.col("level"))
    return level.select("source", "source_size", F.coalesce(full, "cap").alias("target"))


def _narrow(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """One small row per document: what the draw needs, without the text."""
    body = docs[f"`{text}`"]
    sized = docs.select(
        docs[f"`{key}`"].alias("key"),
        docs[f"`{source}`"].alias("source"),
        F.xxhash64(body).alias("digest"),
        let(size_of(body), lambda n: F.struct(n.alias("size"), quality_of(body, n).alias("quality"))).alias("s"),
    )
    drawn = -F.log(unit_hash("key", salt=seed)) / F.col("s.quality")
    # Any monotone map to cells would do. Of the documents of one quality q a cell
    # gets (1 + d)^2 q exp(-q d) / CELLS at most, which is below 6 / CELLS from
    # MIN_QUALITY up: no cell is more than a thousandth of a source.
    cell = F.floor(F.lit(CELLS) * drawn / (1 + drawn)).cast("int")
    return stage(
        sized.select("key", "source", "digest", F.col("s.size").alias("size"), drawn.alias("draw"), cell.alias("cell"))
    )


def draw(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 6
) -> DataFrame:
    """``key, digest, size, source_size, target, epochs`` per row; ``epochs`` is
    how often the mix takes the document."""
    rows = _narrow(docs, key, text, source, seed)
    per_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    per_cell = stage(per_cell)
    sizes = per_cell.groupBy("source").agg(F.sum("words").alias("source_size"))
    budget = targets(sizes).select(
        "source",
        "source_size",
        "target",
        F.coalesce(
            F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)
        ).cast("long").alias("full"),
    )
    budget = budget.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    # a source has at most CELLS rows here
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = per_cell.select("source", "cell", "words", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
    bounded = budget.alias("b").join(
        cells.alias("c"),
        F.col("b.source").eqNullSafe(F.col("c.source"))
        & (F.col("c.before") <= F.col("b.rest"))
        & (F.col("b.rest") < F.col("c.before") + F.col("c.words")),
        "left",
    )
    bounds = stage(
        bounded.select(
            F.col("b.source").alias("of"), "source_size", "target", "full", "rest",
            F.col("c.cell").alias("edge"), F.col("c.before").alias("before"),
        )
    )
    known = rows.join(bounds, rows["source"].eqNullSafe(bounds["of"]))
    columns = ("key", "digest", "size", "source_size", "target")
    clear = known.where(~F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))).select(
        *columns,
        (F.col("full") + F.when(F.coalesce(F.col("cell") < F.col("edge"), F.lit(False)), 1).otherwise(0)).alias("epochs"),
    )
    inside = Window.partitionBy("of", "cell").orderBy("draw", "key", "size", "digest").rowsBetween(
        Window.unboundedPreceding, -1
    )
    edge = known.where(F.col("cell") == F.col("edge"))
    so_far = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    ranked = edge.select(
        *columns,
        (F.col("full") + F.when(so_far + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).alias("epochs"),
    )
    return clear.union(ranked)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document its size, its source's size and target, and the words taken."""
    return draw(docs, key, text, source).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken")
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, all its columns."""
    drawn = draw(docs, key, text, source).where(F.col("epochs") > 0)
    # rows with one key and text are equal to the draw: spread their copies
    counts = (
        drawn.select(*matching(F.col("key"), F.col("digest")), "epochs")
        .groupBy(*MATCH)
        .agg(F.sum("epochs").alias("copies"), F.count(F.lit(1)).alias("same"))
    )
    whole = packed(docs, key=docs[f"`{key}`"], digest=F.xxhash64(docs[f"`{text}`"]))
    taken = whole.select("row", *matching(F.col("key"), F.col("digest"))).join(counts, MATCH)
    once = F.row_number().over(Window.partitionBy(*MATCH).orderBy(F.lit(0)))
    share = taken.withColumn("nth", once).select(
        "row",
        (F.floor(F.col("copies") / F.col("same")) + F.when(F.col("nth") <= F.col("copies") % F.col("same"), 1).otherwise(0)).alias("n"),
    )
    return share.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
