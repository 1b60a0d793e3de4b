"""Command line: ``python -m corpusloom <job> ...`` (also with spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corpusloom.operators.quota import PER_GROUP_CAP, SIZE
from corpusloom.operators.split import TEST_FRAC, VAL_FRAC
from corpusloom.plans import jobs
from corpusloom.sources.readers import read_manifest
from corpusloom.sources.staging import purge


def _named(text: str) -> tuple[str, str]:
    name, _, path = text.partition("=")
    if not path:
        raise argparse.ArgumentTypeError("give name=path")
    return name, path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    job = top.add_subparsers(dest="job", required=True)

    clean = job.add_parser("clean", help="normalise and check the targets of a corpus")
    clean.add_argument("inp")
    clean.add_argument("out")

    subset = job.add_parser("subset", help="pick questions by quota, as chat records")
    for flag in ("--questions", "--catalog", "--out", "--manifest"):
        subset.add_argument(flag, required=True)
    subset.add_argument("--n", type=int, default=SIZE)
    subset.add_argument("--per-db-cap", type=int, default=PER_GROUP_CAP)
    subset.add_argument("--seed", type=int, default=42)
    subset.add_argument("--array", action="store_true", help="inputs are JSON arrays, not JSON Lines")

    split = job.add_parser("split", help="merge sources and split them")
    split.add_argument("--source", type=_named, action="append", required=True,
                       metavar="NAME=PATH")
    split.add_argument("--outdir", required=True)
    split.add_argument("--seed", type=int, default=42)
    split.add_argument("--val-frac", type=float, default=VAL_FRAC)
    split.add_argument("--test-frac", type=float, default=TEST_FRAC)
    split.add_argument("--stored-ord", action="append", default=[], metavar="NAME",
                       help="this source was written by the clean job")

    profile = job.add_parser("profile", help="print statistics of corpora")
    profile.add_argument("paths", nargs="+")

    score = job.add_parser("score", help="score predictions against gold records")
    score.add_argument("gold")
    score.add_argument("pred")
    score.add_argument("--fenced", action="store_true")
    score.add_argument("--first", type=int)
    score.add_argument("--manifest", help="manifest that the split job wrote, for scores by group")
    score.add_argument("--keys", nargs="+", default=["source", "bucket"])
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"corpusloom {a.job}").getOrCreate()
    try:
        if a.job == "clean":
            print(jobs.clean_corpus(spark, a.inp, a.out))
        elif a.job == "subset":
            jobs.build_subset(spark, a.questions, a.catalog, a.out, a.manifest, a.n,
                              a.per_db_cap, a.seed, array=a.array)
        elif a.job == "split":
            jobs.merge_and_split(spark, dict(a.source), a.outdir, a.seed, a.val_frac,
                                 a.test_frac, a.stored_ord)
        elif a.job == "profile":
            jobs.profile_corpus(spark, a.paths).show(len(a.paths), truncate=False, vertical=True)
        else:
            listed = read_manifest(spark, a.manifest) if a.manifest else None
            jobs.score_predictions(
                spark, a.gold, a.pred, a.fenced, a.first, listed, a.keys, by_id=listed is not None
            ).show(1000, truncate=False)
    finally:
        purge(spark)


if __name__ == "__main__":
    main()
