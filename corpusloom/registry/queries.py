"""One query per operator: a function from (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.features import (
    FEATURES, padded, uses_window, with_bucket, with_features,
)
from corpusloom.functions import prompts as pr
from corpusloom.functions.prompts import TEMPLATES, message
from corpusloom.functions.structure import structure_ok
from corpusloom.operators import (
    audits, checks, dedupe, near, quota, results, scoring, sketches, split, stats,
)
from corpusloom.operators.joins import (
    align, attach_evidence, attach_schema, remaining, with_group_size,
)
from corpusloom.operators.ordering import head, take_first, with_shuffle_key
from corpusloom.operators.quota import QUOTAS
from corpusloom.operators.split import SPLITS
from corpusloom.plans import jobs
from corpusloom.registry.derived import (
    EVIDENCE_SQL, candidates, cases, catalog, column_candidates, corpus, predictions, table,
)
from corpusloom.sources.readers import (
    read_chat, read_manifest, read_predictions, read_questions, read_splits,
)
from corpusloom.sources.staging import shared_folder, stage
from corpusloom.sources.writers import write_jsonl, write_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters the oracles share.
SEED = 42
CAP = 13
BINDING_CAP = 3
LARGE_CAP = 150
HALF_QUOTAS = {name: quota // 2 for name, quota in QUOTAS.items()}
SAMPLE = 500
TRUNCATED = 300
TOP_K = 100
TAKE = 1_200
TOKEN_CAP = 2048
TEMPLATE = "header_id"
OTHER_TEMPLATE = "im_sep"
REPLICATES = 40


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("sql", tx.collapse_sql(F.col("sql_raw")))
    return with_bucket(rows, "sql").drop("sql_raw")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("sql", tx.collapse_sql(F.col("sql_raw")))
    first = dedupe.dedupe_paraphrases(rows.drop("sql_raw"))
    return with_shuffle_key(with_bucket(first, "sql"), SEED)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(pool(spark, sf_dir).drop("shuffle_key"))
    return split.stratified_split(rows, ["source", "bucket"], SEED, narrow=rows)


def records(spark: SparkSession, sf_dir: str, target=tx.clean_target) -> DataFrame:
    """Chat records of the whole corpus: ``rec_id, source, messages``."""
    rows = corpus(spark, sf_dir).withColumn("sql", target(F.col("sql_raw")))
    joined = attach_schema(rows, jobs.with_schema_text(catalog(spark, sf_dir)))
    chat = pr.to_chat(*map(F.col, ("db_id", "schema_text", "question", "sql")))
    return joined.select("rec_id", "source", chat.alias("messages"))


def answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = corpus(spark, sf_dir).select(
        F.col("rec_id").alias("ord"), tx.clean_target(F.col("sql_raw")).alias("gold")
    )
    pred = predictions(spark, sf_dir).select(
        F.col("rec_id").alias("ord"), tx.unfence(F.col("pred_raw")).alias("pred")
    )
    return gold, pred


# ---- text -------------------------------------------------------------------

@register
def collapse_sql(spark, sf_dir):
    return corpus(spark, sf_dir).select("rec_id", tx.collapse_sql(F.col("sql_raw")).alias("sql"))


@register
def clean_target(spark, sf_dir):
    raw = F.col("sql_raw")
    return corpus(spark, sf_dir).select(
        "rec_id", tx.clean_target(raw).alias("sql"), tx.had_semicolon(raw).alias("fixed")
    )


@register
def norm_sql(spark, sf_dir):
    return corpus(spark, sf_dir).select("rec_id", tx.norm_sql(F.col("sql_raw")).alias("sql"))


@register
def mask_backticks(spark, sf_dir):
    return corpus(spark, sf_dir).select("rec_id", tx.mask_backticks(F.col("sql_raw")).alias("sql"))


@register
def unfence(spark, sf_dir):
    return predictions(spark, sf_dir).select("rec_id", tx.unfence(F.col("pred_raw")).alias("sql"))


@register
def db_of(spark, sf_dir):
    return records(spark, sf_dir).select("rec_id", tx.db_of(message(1)).alias("db"))


@register
def question_tail(spark, sf_dir):
    return records(spark, sf_dir).select("rec_id", tx.question_tail(message(1)).alias("question"))


@register
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.est_tokens(F.col("text")).alias("tokens")
    )


# ---- structure --------------------------------------------------------------

@register
def bucket_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("source", "bucket").agg(F.count("*").alias("n"))


@register
def bucket_raw(spark, sf_dir):
    return with_bucket(corpus(spark, sf_dir), "sql_raw").select("rec_id", "bucket")


@register
def feature_flags(spark, sf_dir):
    return with_features(corpus(spark, sf_dir), "sql_raw").select(
        "rec_id", *[f"has_{name}" for name in FEATURES]
    )


@register
def feature_totals(spark, sf_dir):
    return stats.feature_totals(with_features(corpus(spark, sf_dir), "sql_raw"))


@register
def feature_rollup(spark, sf_dir):
    return stats.feature_rollup(with_features(corpus(spark, sf_dir), "sql_raw"))


# ---- prompts ----------------------------------------------------------------

@register
def render_schema(spark, sf_dir):
    return jobs.with_schema_text(catalog(spark, sf_dir))


@register
def build_records(spark, sf_dir):
    return records(spark, sf_dir).select(
        "rec_id", *[message(i).alias(name) for i, name in enumerate(("sys", "usr", "target"))]
    )


@register
def prompt_evidence(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("evidence", F.expr(EVIDENCE_SQL))
    joined = attach_schema(rows, jobs.with_schema_text(catalog(spark, sf_dir)))
    text = pr.prompt(*map(F.col, ("db_id", "schema_text", "question", "evidence")))
    return joined.select("rec_id", text.alias("prompt"))


@register
def render_chat(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.select(
        "rec_id", *[pr.render_chat("messages", t).alias(name) for name, t in TEMPLATES.items()]
    )


@register
def completion_span(spark, sf_dir):
    text = F.col("text")
    own = TEMPLATES[TEMPLATE].response_marker
    other = TEMPLATES[OTHER_TEMPLATE].response_marker
    rendered = records(spark, sf_dir).select(
        "rec_id", pr.render_chat("messages", TEMPLATES[TEMPLATE]).alias("text")
    )
    return rendered.select(
        "rec_id",
        pr.marker_found(text, own).alias("found"),
        pr.prompt_part(text, own).alias("prompt"),
        pr.completion(text, own).alias("completion"),
        pr.marker_found(text, other).alias("other_found"),
        pr.completion(text, other).alias("other_completion"),
    )


# ---- gates ------------------------------------------------------------------

@register
def role_check(spark, sf_dir):
    return checks.role_report(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@register
def clean_records(spark, sf_dir):
    as_they_came = records(spark, sf_dir, target=lambda sql: sql).withColumnRenamed("rec_id", "ord")
    return jobs.cleaned(as_they_came).select(
        F.col("ord").alias("rec_id"), message(2).alias("sql"), "fixed", "parses"
    )


@register
def parse_gate(spark, sf_dir):
    """Ids the structural gate refuses; it tests structure, not grammar."""
    rows = corpus(spark, sf_dir).select(
        "rec_id", structure_ok(F.col("sql_raw")).alias("parses")
    )
    return checks.rejects(rows, "parses", "rec_id")


@register
def cleaning_report(spark, sf_dir):
    raw = F.col("sql_raw")
    rows = corpus(spark, sf_dir).select(
        tx.had_semicolon(raw).alias("fixed"),
        structure_ok(tx.clean_target(raw)).alias("parses"),
    )
    return stats.cleaning_report(rows)


@register
def window_function_audit(spark, sf_dir):
    rows = corpus(spark, sf_dir).select(padded(F.col("sql_raw")).alias("s"))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(uses_window(F.col("s"))).alias("n_window")
    )


@register
def alignment_check(spark, sf_dir):
    gold = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"))
    pred = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return checks.alignment(align(gold, pred))


@register
def cap_audit(spark, sf_dir):
    return checks.over_cap(table(spark, sf_dir, "documents"), "text", TOKEN_CAP)


# ---- selection --------------------------------------------------------------

@register
def dedupe_first(spark, sf_dir):
    return pool(spark, sf_dir).select("rec_id", "db_id", "question", "sql", "bucket")


@register
def dedupe_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spaced = tx.strip(tx.one_blank(F.col("text")))
    first = dedupe.dedupe_first(
        docs, {"source": F.col("source"), "text": dedupe.text_key(spaced)}, "doc_id"
    )
    return first.select("doc_id", "source")


@register
def shuffle_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return take_first(with_shuffle_key(docs, SEED, "doc_id"), TOP_K, "doc_id")


@register
def shuffle_take(spark, sf_dir):
    """More rows than a merged limit should handle: cut by cell instead."""
    rows = corpus(spark, sf_dir).select("rec_id", "source")
    return take_first(with_shuffle_key(rows, SEED), TAKE)


@register
def first_rows(spark, sf_dir):
    return head(corpus(spark, sf_dir).select("rec_id", "source", "question"), 3, "rec_id")


def _picks(sample_picks: DataFrame) -> DataFrame:
    return sample_picks.select("rec_id", "db_id", "bucket", "pick_pass")


@register
def quota_fill(spark, sf_dir):
    return _picks(quota.quota_fill(stage(pool(spark, sf_dir)), QUOTAS, cap=CAP).picks)


@register
def quota_binding_cap(spark, sf_dir):
    return _picks(quota.quota_fill(stage(pool(spark, sf_dir)), QUOTAS, cap=BINDING_CAP).picks)


@register
def quota_large_cap(spark, sf_dir):
    return _picks(quota.quota_fill(stage(pool(spark, sf_dir)), QUOTAS, cap=LARGE_CAP).picks)


@register
def quota_topup(spark, sf_dir):
    sample = quota.quota_fill(stage(pool(spark, sf_dir)), HALF_QUOTAS, cap=CAP)
    return _picks(sample.top_up(SAMPLE).picks)


@register
def quota_truncated(spark, sf_dir):
    return _picks(quota.quota_fill(stage(pool(spark, sf_dir)), QUOTAS, cap=CAP).head(TRUNCATED))


@register
def fill_counts(spark, sf_dir):
    sample = quota.quota_fill(stage(pool(spark, sf_dir)), HALF_QUOTAS, cap=CAP).top_up(SAMPLE)
    return quota.fill_counts(sample.picks)


@register
def remaining_pool(spark, sf_dir):
    rows = stage(pool(spark, sf_dir))
    return remaining(rows, take_first(rows, TOP_K)).select("rec_id", "bucket")


# ---- split ------------------------------------------------------------------

@register
def stratified_split(spark, sf_dir):
    return labelled(spark, sf_dir).select("rec_id", "source", "bucket", "split")


@register
def split_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labelled_docs = split.stratified_split(
        docs, ["lang", "source"], SEED, row_id="doc_id", narrow=docs
    )
    return labelled_docs.select("doc_id", "split")


@register
def split_stats(spark, sf_dir):
    return stats.split_stats(labelled(spark, sf_dir))


@register
def distinct_dbs(spark, sf_dir):
    return stats.distinct_dbs(corpus(spark, sf_dir))


@register
def group_size(spark, sf_dir):
    rows = stage(classified(spark, sf_dir).select("rec_id", "source", "bucket"))
    return with_group_size(rows, ["source", "bucket"])


@register
def split_union_roundtrip(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("rec_id", "db_id", "sql", "split")
    parts = stage(rows)
    merged = split.union_splits(
        {name: parts.where(F.col("split") == name).drop("split") for name in SPLITS}
    )
    return merged.select("rec_id", "db_id", "sql")


@register
def merged_order(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("rec_id", "split")
    return split.merged_order(rows, SEED + 1).select("rec_id", "split", "position")


@register
def merge_sources(spark, sf_dir):
    rows = stage(records(spark, sf_dir).withColumn("ord", F.col("rec_id")))
    parts = {
        name: rows.where(F.col("source") == name).select("ord", "messages")
        for name in ("alpha", "beta")
    }
    return jobs.merge_rows(parts).drop("messages")


# ---- statistics -------------------------------------------------------------

@register
def length_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.length("text").alias("chars"))
    return stats.length_profile(docs, "chars")


@register
def length_profile_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.length("text").alias("chars"))
    return stats.length_profile(docs, "chars", ["source"])


@register
def length_preview(spark, sf_dir):
    return stats.length_preview(table(spark, sf_dir, "documents"), "text", order_by="doc_id")


@register
def profile_corpus(spark, sf_dir):
    return jobs.profile(records(spark, sf_dir), "source")


# ---- scores -----------------------------------------------------------------

@register
def score(spark, sf_dir):
    return scoring.score(jobs.score_pairs(*answers(spark, sf_dir)))


@register
def score_by_stratum(spark, sf_dir):
    manifest = classified(spark, sf_dir).select(F.col("rec_id").alias("ord"), "source", "bucket")
    flags = jobs.score_pairs(*answers(spark, sf_dir))
    return scoring.score_by(flags, manifest, ["source", "bucket"], "ord")


@register
def score_by_tier(spark, sf_dir):
    """Scores by bucket and in total with intervals."""
    tiers = classified(spark, sf_dir).select(F.col("rec_id").alias("ord"), F.col("bucket").alias("tier"))
    flags = jobs.score_pairs(*answers(spark, sf_dir)).join(tiers, "ord")
    return scoring.score_by_tier(flags, "tier", "ord", REPLICATES)


@register
def score_samples(spark, sf_dir):
    rows = records(spark, sf_dir).withColumnRenamed("rec_id", "ord")
    pred = answers(spark, sf_dir)[1].withColumnRenamed("pred", "sql")
    return jobs.samples(rows, pred)

# ---- texts with both outcomes -------------------------------------------------

@register
def case_features(spark, sf_dir):
    rows = with_bucket(with_features(cases(spark, sf_dir), "sql_raw"), "sql_raw")
    return rows.select("rec_id", "bucket", *[f"has_{name}" for name in FEATURES])


@register
def case_window_audit(spark, sf_dir):
    rows = cases(spark, sf_dir).select(padded(F.col("sql_raw")).alias("s"))
    return rows.agg(F.count("*").alias("n"), F.count_if(uses_window(F.col("s"))).alias("n_window"))


@register
def case_structure(spark, sf_dir):
    return cases(spark, sf_dir).select("rec_id", structure_ok(F.col("sql_raw")).alias("sound"))


@register
def case_roles(spark, sf_dir):
    turns = F.transform("roles", lambda r: F.struct(r.alias("role"), F.col("sql_raw").alias("content")))
    return checks.check_roles(cases(spark, sf_dir).select("rec_id", turns.alias("messages")), "rec_id")


# ---- audits, results, evidence ----------------------------------------------

@register
def duplicate_audit(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return audits.duplicates(rows, [F.col("db_id"), tx.norm_sql(F.col("sql_raw"))], "rec_id")


@register
def duplicate_documents(spark, sf_dir):
    return audits.duplicates(table(spark, sf_dir, "documents"), [F.col("text")], "doc_id")


@register
def leak_audit(spark, sf_dir):
    """Documents with a line that is a line of a benchmark text, to the letter;
    leaked passages are found by ``benchmark_leaks``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    return audits.leaks(docs, wanted, ["line"], "doc_id").distinct()


@register
def benchmark_leaks(spark, sf_dir):
    """Documents that share a passage with a benchmark text."""
    return audits.passage_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", "doc_id")


@register
def split_leak_audit(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("rec_id", "split", F.upper("sql").alias("sql"))
    return audits.split_leaks(rows, ["sql"])


@register
def split_near_leaks(spark, sf_dir):
    """Rows with the words, nearly, of a row of another split."""
    rows = labelled(spark, sf_dir)
    return near.split_near_leaks(rows, near.word_set(rows["question"], rows["sql"]))


@register
def result_match(spark, sf_dir):
    return results.result_match(candidates(spark, sf_dir))


@register
def result_match_columns(spark, sf_dir):
    return results.result_match_columns(column_candidates(spark, sf_dir))


@register
def vote(spark, sf_dir):
    return results.vote(candidates(spark, sf_dir))


@register
def evidence_attach(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("rec_id", "question")
    listed = rows.select("question").distinct().where(F.length("question") % 2 == 0)
    known = listed.withColumn("evidence", F.concat(F.lit("see "), F.col("question")))
    return attach_evidence(rows, known)


# ---- sources that are appended -------------------------------------------------

def _halves(df: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows up to the middle id, and those after it."""
    rows = stage(df)
    middle = rows.agg(F.floor((F.min(by) + F.max(by)) / 2)).first()[0] or 0
    return rows.where(F.col(by) <= middle), rows.where(F.col(by) > middle)


@register
def quota_fill_appended(spark, sf_dir):
    """The topped-up sample from the state of the first half and the second."""
    old, new = _halves(pool(spark, sf_dir), "rec_id")
    state = quota.quota_fill(old, HALF_QUOTAS, cap=CAP).top_up(SAMPLE).state()
    both = state.unionByName(new)
    return quota.quota_fill(both, HALF_QUOTAS, cap=CAP).top_up(SAMPLE).picks.select(
        "rec_id", "db_id", "bucket", "pick_pass")


@register
def split_appended(spark, sf_dir):
    """The first half split, then the second half added to its strata."""
    strata = ["source", "bucket"]
    old, new = _halves(pool(spark, sf_dir).drop("shuffle_key"), "rec_id")
    first = stage(split.stratified_split(old, strata, SEED))
    more, _ = split.split_appended(new, split.split_counts(first, strata), strata, SEED)
    return first.unionByName(more).select("rec_id", "source", "bucket", "split")


@register
def dedupe_appended(spark, sf_dir):
    """Paraphrases of the second half deduplicated against what the first kept."""
    rows = corpus(spark, sf_dir).withColumn("sql", tx.collapse_sql(F.col("sql_raw"))).drop("sql_raw")
    old, new = _halves(with_bucket(rows, "sql"), "rec_id")
    keys = {"db": F.col("db_id"), "sql": F.upper("sql")}
    kept = dedupe.KeptKeys(spark, f"kept_{uuid.uuid4().hex}", _folder(spark), 8)
    parts = [kept.append(part, keys, "rec_id") for part in (old, new)]
    return parts[0].unionByName(parts[1]).select("rec_id", "db_id", "question", "sql", "bucket")


@register
def profile_merged(spark, sf_dir):
    """Profiles of two halves of the documents, merged, by source and in total."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("chars"))
    halves = [stage(sketches.profile(part, "source", "lang", "chars")) for part in _halves(docs, "doc_id")]
    merged = stage(sketches.merge(*halves, by="source"))
    return sketches.read(merged.unionByName(sketches.total(merged, "source")), "source")


# ---- jobs over files: every record is written as JSON Lines and read back ---

def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _written(
    df: DataFrame, order_by: list[str], columns: list[str], compression: str | None = None
) -> str:
    path = _folder(df.sparkSession)
    write_jsonl(df, path, order_by, columns=columns, compression=compression)
    return path


@register
def jsonl_round_trip(spark, sf_dir):
    path = _written(records(spark, sf_dir), ["rec_id"], ["messages"])
    back = read_chat(spark, path)
    return back.select("ord", message(1).alias("usr"), message(2).alias("target"))


def _subset(spark: SparkSession, sf_dir: str, out: str, manifest: str) -> DataFrame:
    questions = corpus(spark, sf_dir).withColumnRenamed("sql_raw", "query")
    columns = ["db_id", "query", "question"]
    schemas = catalog(spark, sf_dir)
    return jobs.build_subset(
        spark,
        _written(questions, ["rec_id"], columns),
        _written(schemas, ["db_id"], schemas.columns),
        out, manifest, SAMPLE, CAP, SEED, HALF_QUOTAS,
    )


def _merged(spark: SparkSession, sf_dir: str) -> str:
    """Folder with what the merge job writes."""
    rows = stage(records(spark, sf_dir))
    sources = {
        name: _written(rows.where(F.col("source") == name), ["rec_id"], ["messages"], "gzip")
        for name in ("alpha", "beta")
    }
    out = _folder(spark)
    jobs.merge_and_split(spark, sources, out, SEED, compression="gzip")
    return out


@register
def build_subset(spark, sf_dir):
    return _subset(spark, sf_dir, _folder(spark), _folder(spark))


@register
def merge_and_split(spark, sf_dir):
    return read_manifest(spark, f"{_merged(spark, sf_dir)}/manifest")


@register
def score_predictions(spark, sf_dir):
    gold = _written(records(spark, sf_dir), ["rec_id"], ["messages"])
    pred = predictions(spark, sf_dir).withColumnRenamed("pred_raw", "sql")
    return jobs.score_predictions(
        spark, gold, _written(pred, ["rec_id"], ["sql"]), fenced=True
    )

@register
def reader_layout_change(spark, sf_dir):
    """Records numbered under one layout of the scan and read under another."""
    answers_ = predictions(spark, sf_dir).withColumnRenamed("pred_raw", "sql")
    path = _written(answers_, ["rec_id"], ["sql"])
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, 16)
        numbered = read_predictions(spark, path)
        spark.conf.set(name, 1)
        return stage(numbered.select("ord", F.length("sql").alias("chars")))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@register
def merged_records(spark, sf_dir):
    """The merged set as the job writes it, in its order."""
    out = _merged(spark, sf_dir)
    back = read_chat(spark, f"{out}/records", stored_ord="position", with_id=True)
    return back.select("ord", "rec_id", message(1).alias("usr"), message(2).alias("target"))


@register
def named_splits(spark, sf_dir):
    """Every split read by name, its lines numbered from 0."""
    out = _merged(spark, sf_dir)
    splits = read_splits(spark, {name: f"{out}/records/split={name}" for name in SPLITS})
    return splits.select("split", "ord", message(2).alias("target"))


@register
def subset_records(spark, sf_dir):
    """The subset's chat records as the job writes them, in their order."""
    out = _folder(spark)
    _subset(spark, sf_dir, out, _folder(spark))
    return read_chat(spark, out).select("ord", message(1).alias("usr"), message(2).alias("target"))


@register
def score_by_manifest(spark, sf_dir):
    """Predictions for the written test split, scored by the written manifest."""
    out = _merged(spark, sf_dir)
    test = f"{out}/records/split=test"
    gold = read_chat(spark, test, with_id=True).select("ord", message(2).alias("target"))
    answer = F.when(F.length("target") % 3 == 0, F.lit("SELECT FROM WHERE")).otherwise(F.lower("target"))
    pred = _written(gold.select("ord", answer.alias("sql")), ["ord"], ["sql"], "gzip")
    return jobs.score_predictions(
        spark, test, pred, manifest=read_manifest(spark, f"{out}/manifest"),
        keys=["source", "bucket"], by_id=True,
    )


@register
def clean_job(spark, sf_dir):
    """The clean job over a written file without broken targets."""
    sound = records(spark, sf_dir, target=lambda sql: sql).where(structure_ok(message(2)))
    out = _folder(spark)
    jobs.clean_corpus(spark, _written(sound, ["rec_id"], ["messages"]), out)
    back = read_chat(spark, f"{out}/records", stored_ord=True)
    report = spark.read.json(f"{out}/report").select("records", "fixed_semicolons", "unparseable")
    return back.select("ord", message(2).alias("sql")).join(F.broadcast(report))


@register
def profile_paths(spark, sf_dir):
    """The profile job over two written files."""
    rows = stage(records(spark, sf_dir))
    paths = {
        _written(rows.where(F.col("source") == name), ["rec_id"], ["messages"]): name
        for name in ("alpha", "beta")
    }
    named = F.create_map(*[F.lit(x) for pair in paths.items() for x in pair])
    return jobs.profile_corpus(spark, list(paths)).withColumn("path", named[F.col("path")])


@register
def questions_array(spark, sf_dir):
    """Questions from several files of one JSON array each."""
    rows = corpus(spark, sf_dir).select("rec_id", "db_id", F.col("sql_raw").alias("query"), "question")
    chunk = F.floor(F.col("rec_id") / 4000)
    arrays = rows.groupBy(chunk.alias("chunk")).agg(
        F.to_json(F.transform(
            F.sort_array(F.collect_list(F.struct("rec_id", "db_id", "query", "question"))),
            lambda r: F.struct(r["db_id"].alias("db_id"), r["query"].alias("query"), r["question"].alias("question")),
        )).alias("value")
    )
    path = _folder(spark)
    n = arrays.count()
    arrays.repartitionByRange(n, "chunk").sortWithinPartitions("chunk").select("value").write.text(path)
    return read_questions(spark, path, array=True)


@register
def questions_one_array(spark, sf_dir):
    """Questions from one file that is one JSON array; their texts hold brackets,
    quotes and escapes."""
    said = F.concat("question", F.lit(' "}, {" [\\" \\\\'), F.col("rec_id") % 3, F.lit("\n]}"))
    rows = corpus(spark, sf_dir).select("rec_id", F.to_json(F.struct(
        "db_id", F.col("sql_raw").alias("query"), said.alias("question"),
    )).alias("value"))
    ends = spark.createDataFrame([(None, "[", 0), (None, "]", 2)], "rec_id bigint, value string, part int")
    first = rows.agg(F.min("rec_id")).first()[0]
    comma = F.when(F.col("rec_id") == first, F.lit("")).otherwise(F.lit(","))
    lines = rows.select("rec_id", F.concat(comma, "value").alias("value"), F.lit(1).alias("part")).unionByName(ends)
    path = _folder(spark)
    write_lines(stage(lines.orderBy("part", "rec_id").select("value")), path)
    return read_questions(spark, path, array=True)
