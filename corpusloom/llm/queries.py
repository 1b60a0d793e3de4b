"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.llm import (
    bpe,
    hard_negatives,
    licenses,
    mixing,
    pii,
    quality_rank,
    rule_cascade,
    simhash,
    token_frames,
    toxicity,
    warc,
    weighted_sampling,
    whitening,
)
from corpusloom.llm.common import documents, held_out, labels
from corpusloom.llm.oracles import ORACLES


def _held_out_first(rows: DataFrame, held: Column) -> DataFrame:
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")


def op1_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 4, 2)
    vectors = quality_rank.vectors_of(docs, "doc_id", "text")
    ranking = quality_rank.train(docs, labels(spark, sf_dir), "doc_id", "text", "quality", ~held, vectors)
    return _held_out_first(quality_rank.scored(docs, "doc_id", "text", ranking, vectors), held)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(documents(spark, sf_dir), "doc_id", "text", ranks, public_tokenizers.PATTERN)


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_frames.write_and_read(documents(spark, sf_dir), path, end_ids=[1])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: source/lang/hundred/name, where the first of a
    hundred is its directory's licence file and those of a thousand their
    parent's."""
    docs = documents(spark, sf_dir)
    i = F.col("doc_id")
    hundred = F.concat_ws("/", "source", "lang", (i % 1000 - i % 100).cast("string"))
    path = (
        F.when(i % 20 == 0, F.concat(F.coalesce("source", F.lit("")), F.lit("/LICENSE-"), i))
        .when(i % 20 == 1, F.concat(hundred, F.lit("/LICENSE-"), i))
        .otherwise(F.concat(hundred, F.lit("/"), i, F.lit(".txt")))
    )
    return licenses.scan(docs, "doc_id", path)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, labels(spark, sf_dir), "doc_id", "text", "toxic", ~held)
    return _held_out_first(toxicity.scored(docs, "doc_id", "text", model), held)


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edits(documents(spark, sf_dir))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.report(documents(spark, sf_dir), "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, lambda i: i % 100 == 0, label=moved)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rank,
        op2_bpe,
        op3_token_frames,
        op4_licenses,
        op5_pii,
        op6_mixing,
        op7_simhash,
        op8_toxicity,
        op9_weighted_sampling,
        op10_rule_cascade,
        op11_whitening,
        op12_hard_negatives,
        op13_warc,
    )
}
__all__ = ["ORACLES", "QUERIES"]
