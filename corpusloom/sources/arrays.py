"""One large JSON array read by many tasks.

An array of objects has no line structure, and whether a brace ends a record
depends on everything before it: on the quotes, which may open a string, and on
the depth. The file is therefore read in blocks, each of which says what it does to
every state it may begin in:

1. The text reader cuts the file at ``}``, by any number of tasks, whatever the
   splits are. Pieces are put together again to blocks of ``BLOCK`` bytes or so,
   which begin with a brace (but for a file's first) and are staged.
2. A block is scanned once for both start states, inside and outside a string: the
   state at its end, the change of depth, and how many braces land on which
   relative depth. No start state with a pending escape is needed, as JSON has no
   escaped brace.
3. Running sums over these few numbers per block, in file order, compose the
   blocks: they give the true state, depth and record number at each start.
4. Every block then cuts its records by itself. What a block begins or leaves
   unfinished are fragments; those of one record meet by its number.

A record is numbered by its place in the array, files in natural order. Text that
is no array of objects, is not closed, or holds something else between the
records fails the job with the number of the record and the file.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.operators.joins import lookup_join
from corpusloom.sources.staging import stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20
PLACE = ["file", "start", "no"]
# per start state, 0 outside and 1 inside a string
STATES = (
    "file string, start bigint, no int, flips int, delta_0 bigint, lands_0 map<bigint, bigint>, "
    "delta_1 bigint, lands_1 map<bigint, bigint>, body binary"
)

QUOTE, ESCAPE = ord('"'), ord("\\")
OPENING, CLOSING, BRACE = (ord("{"), ord("[")), (ord("}"), ord("]")), ord("}")


class Marks(NamedTuple):
    """Braces and brackets of a block."""

    places: np.ndarray
    odd: np.ndarray  # whether behind an odd number of the block's quotes
    steps: np.ndarray  # of depth
    closing: np.ndarray  # whether a closing brace
    flips: int  # parity of all quotes

    def depths(self, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """Relative depth behind each mark, for a start outside (0) or inside (1)
        a string; and which marks are closing braces that count."""
        counted = self.odd == bool(inside)
        return np.cumsum(np.where(counted, self.steps, 0)), counted & self.closing


def marks(body: bytes) -> Marks:
    data = np.frombuffer(body, np.uint8)
    quotes = np.flatnonzero(data == QUOTE)
    behind = quotes[(quotes > 0) & (data[quotes - 1] == ESCAPE)]
    if len(behind):
        # a quote behind an odd run of escapes belongs to the string
        other = np.flatnonzero(data != ESCAPE)
        before = np.searchsorted(other, behind) - 1
        last = np.where(before >= 0, other[np.maximum(before, 0)], -1)
        quotes = np.setdiff1d(quotes, behind[(behind - 1 - last) % 2 == 1], assume_unique=True)
    step = np.zeros(256, np.int8)
    step[list(OPENING)], step[list(CLOSING)] = 1, -1
    steps = step[data]
    places = np.flatnonzero(steps)
    odd = np.searchsorted(quotes, places) % 2 == 1
    return Marks(places, odd, steps[places].astype(np.int64), data[places] == BRACE, len(quotes) % 2)


def effect(found: Marks, inside: int) -> tuple[int, list[tuple[int, int]]]:
    """Change of depth, and how many closing braces land on each relative depth."""
    depth, braces = found.depths(inside)
    at, times = np.unique(depth[braces], return_counts=True)
    return int(depth[-1]) if len(depth) else 0, list(zip(at.tolist(), times.tolist()))


def blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files in blocks with the effect of each. Staged."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    names = ["file", "start", "no", "flips", "delta_0", "lands_0", "delta_1", "lands_1", "body"]
    lands = pa.map_(pa.int64(), pa.int64())
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), lands, pa.int64(), lands, pa.binary()]
    size = BLOCK

    def row(place: tuple[str, int], no: int, held: list[bytes]) -> pa.RecordBatch:
        body = b"".join(held)
        found = marks(body)
        values = (*place, no, found.flips, *effect(found, 0), *effect(found, 1), body)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the pieces of a split follow each other; a task may have several splits
        place, no, held, length = None, 0, [], 0
        for batch in batches:
            for piece, file, start in zip(*(batch[c].to_pylist() for c in ("value", "file", "start"))):
                if (file, start) != place:
                    if held:
                        yield row(place, no, held)
                    place, no, held, length = (file, start), 0, [], 0
                    first = start == 0
                else:
                    first = False
                if length >= size:
                    yield row(place, no, held)
                    no, held, length = no + 1, [], 0
                held.append(piece if first else b"}" + piece)
                length += len(held[-1])
        if held:
            yield row(place, no, held)

    return stage(pieces.mapInArrow(run, STATES))


def _started(found: DataFrame, order: Column) -> DataFrame:
    """Per block: ``inside, depth, before`` at its start (record numbers within the
    file), and what the whole file comes to. A row per block, no text."""
    by_place = Window.partitionBy("file").orderBy("start", "no")
    earlier = by_place.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    inside = zero(F.sum("flips").over(earlier)) % 2
    states = found.drop("body").withColumn("inside", inside)
    delta = F.when(F.col("inside") == 0, F.col("delta_0")).otherwise(F.col("delta_1"))
    states = states.withColumn("delta", delta).withColumn("depth", zero(F.sum("delta").over(earlier)))
    lands = F.when(F.col("inside") == 0, F.col("lands_0")).otherwise(F.col("lands_1"))
    # a record's last brace lands on depth one
    states = states.withColumn("records", zero(F.try_element_at(lands, 1 - F.col("depth"))))
    return states.select(
        *PLACE, "flips", "delta", "inside", "depth", "records",
        zero(F.sum("records").over(earlier)).alias("before"),
        order.alias("_order"),
    )


def _cut(started: DataFrame) -> DataFrame:
    """Records and fragments of every block: ``file, record, start, no, whole, text``."""
    schema = "file string, record bigint, start bigint, no int, whole boolean, text binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["file", "start", "no", "inside", "depth", "before", "body"]).to_pylist():
                body = r["body"]
                found = marks(body)
                depth, braces = found.depths(r["inside"])
                ends = (found.places[braces & (r["depth"] + depth == 1)] + 1).tolist()
                cuts = list(zip([0, *ends], [*ends, len(body)]))
                # the first may have begun, the last may end in another block
                whole = [0 < i < len(cuts) - 1 for i in range(len(cuts))]
                columns = (
                    [r["file"]] * len(cuts), [r["before"] + i for i in range(len(cuts))], [r["start"]] * len(cuts),
                    [r["no"]] * len(cuts), whole, [body[a:b] for a, b in cuts],
                )
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names)

    return started.mapInArrow(run, schema)


def read_array(spark: SparkSession, path: str | list[str], schema: str, order: Column) -> DataFrame:
    """``ord`` and the fields of every record of files of one JSON array each.
    ``order`` is the files' sort key, of the column ``file``."""
    found = blocks(spark, path)
    states = stage(_started(found, order))
    files = states.groupBy("file", "_order").agg(
        F.sum("records").alias("n"),
        (F.sum("flips") % 2).alias("inside"),
        F.sum("delta").alias("depth"),
    )
    # a row per file
    shift = F.sum("n").over(Window.orderBy("_order", "file")) - F.col("n")
    offsets = stage(files.select("file", "n", "inside", "depth", shift.alias("shift")))
    started = lookup_join(found.select(*PLACE, "body"), states.select(*PLACE, "inside", "depth", "before"), PLACE, staged=True)
    cut = stage(_cut(started))
    several = cut.where(~F.col("whole")).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "no", "text"))).alias("parts")
    )
    # one record's fragments, a few unless it is larger than a block
    joined = several.select("file", "record", F.aggregate(
        "parts", F.lit(b""), lambda a, p: F.concat(a, p["text"])
    ).alias("text"))
    texts = cut.where("whole").select("file", "record", "text").unionByName(joined)
    numbered = lookup_join(texts.withColumn("text", F.col("text").cast("string")), offsets, ["file"], staged=True)

    at = F.concat(F.lit(" at record "), (F.col("shift") + F.col("record")).cast("string"), F.lit(" of "), F.col("file"))
    fail = lambda said: F.raise_error(F.concat(F.lit(said), at))
    first = F.col("record") == 0
    last = F.col("record") == F.col("n")
    blank = "[ \\t\\n\\r]*"
    ended = F.when(first, F.col("text").rlike(f"^\\x{{FEFF}}?{blank}\\[{blank}\\]{blank}$")).otherwise(
        F.col("text").rlike(f"^{blank}\\]{blank}$")
    )
    begun = F.when(first, F.col("text").rlike(f"^\\x{{FEFF}}?{blank}\\[{blank}\\{{")).otherwise(
        F.col("text").rlike(f"^{blank},{blank}\\{{")
    )
    closed = (F.col("inside") == 0) & (F.col("depth") == 0)
    sound = (
        F.when(last & ended & closed, F.lit(False))
        .when(last, fail("no end of the array"))
        .when(~begun, fail("no JSON object"))
        .otherwise(F.lit(True))
    )
    body = F.regexp_replace("text", f"^\\x{{FEFF}}?{blank}[\\[,]{blank}", "")
    parsed = F.from_json(body, f"{schema}, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = numbered.where(sound).select(
        (F.col("shift") + F.col("record")).alias("ord"), F.col("file"), F.col("shift"), F.col("record"), parsed.alias("_r")
    )
    intact = F.when(F.col("_r").isNotNull() & F.col("_r._broken").isNull(), F.col("ord")).otherwise(fail("no JSON object"))
    fields = [c for c in rows.select("_r.*").columns if c != "_broken"]
    return rows.select(intact.alias("ord"), *[F.col(f"_r.{c}").alias(c) for c in fields])
