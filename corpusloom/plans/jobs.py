"""The five jobs: clean, build a subset, merge and split, profile, score."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.features import padded, uses_window, with_bucket, with_features
from corpusloom.functions.prompts import chat, message, render_schema, to_chat
from corpusloom.functions.structure import structure_ok
from corpusloom.functions.text import (
    clean_target, collapse_sql, db_of, had_semicolon, question_tail, unfence,
)
from corpusloom.operators.checks import GateError, alignment, assert_none, gate, require_roles
from corpusloom.operators.dedupe import dedupe_paraphrases
from corpusloom.operators.joins import align, attach_schema, fits_broadcast
from corpusloom.operators.ordering import (
    head, in_order, rows_before, with_position, with_running_position, with_shuffle_key,
)
from corpusloom.operators.quota import PER_GROUP_CAP, QUOTAS, SIZE, fill_counts, quota_fill
from corpusloom.operators.scoring import score, score_by, score_rows
from corpusloom.operators.split import (
    TEST_FRAC, VAL_FRAC, split_by_thresholds, split_rank, split_thresholds,
)
from corpusloom.operators.stats import (
    cleaning_report, distinct_dbs, feature_totals, length_profile, split_stats, split_summary,
)
from corpusloom.sources.readers import (
    read_catalog, read_chat, read_manifest, read_predictions, read_questions, union_named,
)
from corpusloom.sources.staging import stage
from corpusloom.sources.writers import write_jsonl, write_summary

# An output partition holds about this much text.
OUTPUT_BYTES = 128 * 1024 * 1024


# ---- clean ----------------------------------------------------------------

Gate = Callable[[Column], Column]


def cleaned(records: DataFrame, flag: Gate = structure_ok) -> DataFrame:
    """Chat records with a clean target, ``fixed`` and ``parses``, which is what
    ``flag`` says of the target."""
    target = require_roles(records).withColumns({
        "_sql": clean_target(message(2)),
        "fixed": had_semicolon(message(2)),
    })
    sql = F.col("_sql")
    return target.select(
        "ord",
        chat(message(0), message(1), sql).alias("messages"),
        "fixed",
        F.coalesce(flag(sql), F.lit(False)).alias("parses"),
    )


def clean_corpus(spark: SparkSession, inp: str, out: str, flag: Gate = structure_ok) -> dict[str, int]:
    """Clean a chat corpus into ``out/records`` and return the report.

    Records that the gate refuses are written too; their ids go to
    ``out/rejects`` and the job then fails.
    """
    flagged = stage(cleaned(read_chat(spark, inp), flag))
    flagged.select("ord", "messages").write.json(f"{out}/records")
    report = cleaning_report(flagged)
    write_summary(report, f"{out}/report")
    counts = report.first().asDict()
    if counts["unparseable"]:
        gate(flagged, "parses", path=f"{out}/rejects")
    return counts


# ---- build a subset -------------------------------------------------------

def question_pool(questions: DataFrame, seed: int) -> DataFrame:
    """Normalised, deduplicated and classified questions in shuffle order."""
    rows = questions.select(
        F.col("ord").alias("rec_id"), "db_id", "question", collapse_sql(F.col("query")).alias("sql")
    )
    return with_shuffle_key(with_bucket(dedupe_paraphrases(rows), "sql"), seed)


def with_schema_text(catalog: DataFrame) -> DataFrame:
    """Render the schema of every database of the catalog."""
    text = render_schema(
        F.col("table_names_original"), F.col("column_names_original"), F.col("foreign_keys")
    )
    return catalog.select("db_id", text.alias("schema_text"))


def build_subset(
    spark: SparkSession,
    questions: str,
    catalog: str,
    out: str,
    manifest: str,
    n: int = SIZE,
    per_db_cap: int = PER_GROUP_CAP,
    seed: int = 42,
    quotas: Mapping[str, int] = QUOTAS,
    array: bool = False,
) -> DataFrame:
    """Pick ``n`` questions by quota, write them as chat records to ``out`` and
    the selection to ``manifest``. Returns the manifest records."""
    pool = stage(question_pool(read_questions(spark, questions, array), seed))
    assert_none(pool, uses_window(padded(F.col("sql"))), "window functions in the pool")

    sample = quota_fill(pool, quotas, "db_id", per_db_cap).top_up(n)
    picks = sample.head(n).drop("shuffle_key", "pick_pass").withColumn("_all", F.lit(0))
    order = with_position(with_shuffle_key(stage(picks), seed + 1), "_all", out="i")
    chosen = stage(order.drop("_all", "shuffle_key"))

    schemas = with_schema_text(read_catalog(spark, catalog, array))
    record = to_chat(*map(F.col, ("db_id", "schema_text", "question", "sql")))
    records = attach_schema(chosen, schemas).select("i", record.alias("messages"))
    write_jsonl(records, out, ["i"], columns=["messages"])

    listed = chosen.select("i", "db_id", "bucket", "question", "rec_id")
    write_jsonl(listed, f"{manifest}/records", ["i"])
    write_summary(subset_summary(chosen, seed, per_db_cap), f"{manifest}/summary")
    return listed


def subset_summary(chosen: DataFrame, seed: int, per_db_cap: int) -> DataFrame:
    """One row: size, parameters, picks per bucket, distinct databases."""
    per_bucket = fill_counts(chosen).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("bucket_counts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    return per_bucket.select(
        "n", F.lit(seed).alias("seed"), F.lit(per_db_cap).alias("per_db_cap"), "bucket_counts",
        F.lit(distinct_dbs(chosen).first()[0]).alias("distinct_dbs"),
    )


# ---- merge and split ------------------------------------------------------

def merge_rows(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Tag and union the sources; classify the target text as it is."""
    rows = union_named(sources, "source").withColumns({
        "rec_id": F.concat_ws("|", "source", F.col("ord").cast("string")),
        "db": db_of(message(1)),
        "_sql": message(2),
    })
    return with_bucket(rows, "_sql").select("rec_id", "source", "bucket", "db", "messages")


def merge_and_split(
    spark: SparkSession,
    sources: Mapping[str, str],
    outdir: str,
    seed: int = 42,
    val_frac: float = VAL_FRAC,
    test_frac: float = TEST_FRAC,
    stored_ord: Collection[str] = (),
    compression: str | None = None,
) -> DataFrame:
    """Merge the sources and split them by (source, bucket).

    Writes ``records/split=<name>`` and ``manifest/split=<name>``, line by line
    the same records in the same order, with the same ``rec_id`` and
    ``position``, and ``split_stats``. Positions run through training,
    validation and test records: ``read_chat(..., stored_ord="position")`` of
    ``records`` as a whole is the merged set in order. Returns the manifest.
    Sources named in ``stored_ord`` bring their own ``ord``. ``compression`` is
    that of the records and the manifest, whose files hold ``OUTPUT_BYTES`` of
    text each.

    The split is decided on a narrow table; the records themselves are moved
    once, by the shuffle that puts the output in its random order.
    """
    rows = merge_rows({
        name: read_chat(spark, path, name in stored_ord) for name, path in sources.items()
    })
    strata = ["source", "bucket"]
    size = F.octet_length(F.to_json("messages")).cast("long").alias("_bytes")
    narrow = stage(with_shuffle_key(rows.select("*", size).drop("messages"), seed))
    cuts = split_thresholds(narrow, strata, val_frac, test_frac)
    fits = fits_broadcast(cuts)

    def labelled(keyed: DataFrame) -> DataFrame:
        split = split_by_thresholds(keyed, strata, cuts, fits=fits)
        return with_shuffle_key(split, seed + 1).withColumn("_rank", split_rank())

    listed = stage(labelled(narrow))
    measured = listed.groupBy("_rank").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")).collect()
    sizes = {r["_rank"]: r["n"] for r in measured}
    partitions = max(len(sizes), -(-sum(r["b"] for r in measured) // OUTPUT_BYTES))
    order = ["_rank", "shuffle_key", "rec_id"]

    def written(df: DataFrame, name: str, columns: list[str], positions: DataFrame | None) -> DataFrame:
        ranged = in_order(df, "_rank", sizes, partitions).sortWithinPartitions("split", *order)
        if positions is not None:
            ranged = with_running_position(ranged, positions)
        write_jsonl(ranged, f"{outdir}/{name}", [], ["split"], columns, compression)
        return ranged

    ahead = rows_before(listed, "_rank", sizes, partitions)
    written(labelled(with_shuffle_key(rows, seed)), "records", ["rec_id", "position", "messages"], ahead)
    written(listed, "manifest", ["rec_id", "source", "bucket", "db", "position"], ahead)
    summary = split_summary(split_stats(listed)).withColumns({
        "distinct_dbs": F.lit(distinct_dbs(listed, "db").first()[0]), "seed": F.lit(seed),
    })
    write_summary(summary, f"{outdir}/split_stats")
    return read_manifest(spark, f"{outdir}/manifest")


# ---- profile --------------------------------------------------------------

def profile(records: DataFrame, by: str, flag: Gate = structure_ok) -> DataFrame:
    """One row of statistics per value of ``by``."""
    rows = records.select(
        by,
        message(2).alias("_sql"),
        F.length(message(1)).alias("_length"),
        F.substring_index(message(1), "\n", 1).alias("_first_line"),
    )
    flags = with_features(rows.withColumn("parses", F.coalesce(flag(F.col("_sql")), F.lit(False))), "_sql")
    narrow = stage(flags.drop("_sql"))
    parsed = narrow.groupBy(by).agg(F.count_if("parses").alias("parse_ok"))
    return (
        feature_totals(narrow, [by])
        .join(parsed, by)
        .join(length_profile(narrow, "_length", [by]).drop("n"), by)
        .join(distinct_dbs(narrow, "_first_line", [by]), by)
    )


def profile_corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Structure, parse rate and prompt lengths of each chat corpus."""
    return profile(union_named({p: read_chat(spark, p) for p in paths}, "path"), "path")


# ---- score ----------------------------------------------------------------

def score_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Staged flags per position; fails if the two differ in length."""
    aligned = align(gold, pred)
    flags = stage(score_rows(aligned).select("ord", "in_gold", "in_pred", "parse_ok", "em"))
    counts = alignment(flags).first()
    if counts["n_alone"]:
        raise GateError(f"{counts['n_gold']} gold records, {counts['n_pred']} predictions")
    return flags


def score_predictions(
    spark: SparkSession,
    gold: str,
    pred: str,
    fenced: bool = False,
    first: int | None = None,
    manifest: DataFrame | None = None,
    keys: Sequence[str] = (),
    by_id: bool = False,
) -> DataFrame:
    """Parse rate and normalised exact match of a prediction file.

    ``fenced`` takes generated answers and unfences them; ``first`` scores the
    leading gold records only; with ``manifest`` the scores are broken down by
    its ``keys``. Its rows are found by line number (``ord``) or, with
    ``by_id``, by the ``rec_id`` that the gold records carry, as those of the
    merge job do.
    """
    records = read_chat(spark, gold, with_id=by_id)
    answers = read_predictions(spark, pred)
    if first is not None:
        records, answers = [df.where(F.col("ord") < first) for df in (records, answers)]
    sql = unfence(F.col("sql")) if fenced else F.col("sql")
    flags = score_pairs(
        records.select("ord", message(2).alias("gold")), answers.select("ord", sql.alias("pred"))
    )
    if manifest is None:
        return score(flags)
    if by_id:
        flags = flags.join(records.select("ord", "rec_id"), "ord")
    return score_by(flags, manifest, keys, "rec_id" if by_id else "ord")


def samples(gold: DataFrame, pred: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` pairs as shown next to the scores."""
    shown = head(gold.select(
        "ord", question_tail(message(1)).alias("question"), message(2).alias("gold")
    ), n)
    answers = pred.select("ord", F.col("sql").alias("pred"))
    return answers.join(F.broadcast(shown), "ord")
