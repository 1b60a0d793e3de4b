"""Quality gates: find the rows that break a rule, or fail the job on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.prompts import ROLES, roles_ok
from corpusloom.functions.text import est_tokens


class GateError(RuntimeError):
    """A quality gate found rows that must not be there."""


def check_roles(df: DataFrame, row_id: str = "ord") -> DataFrame:
    """Ids of the records that are not exactly system, user, assistant."""
    return df.where(~roles_ok()).select(row_id)


def require_roles(df: DataFrame, row_id: str = "ord") -> DataFrame:
    """Pass records through; the first one with other roles fails the job.

    The test rides along with whatever reads the records next, so it needs no
    pass of its own, and a failed write is never committed.
    """
    bad = F.raise_error(
        F.concat(F.lit("roles are not system, user, assistant in record "),
                 F.col(row_id).cast("string"))
    )
    return df.withColumn("messages", F.when(roles_ok(), F.col("messages")).otherwise(bad))


def role_report(turns: DataFrame, conversation: str, turn: str, role: str) -> DataFrame:
    """Role check on one-row-per-turn input: ``conversation, n_turns, ok``.

    Three turns, one per role, in the order of the roles. Counts and extremes
    replace gathering the turns, so a conversation of any length is reduced to
    one row per task before the shuffle.
    """
    n = F.count(F.lit(1))
    spans = [
        (F.min(F.when(F.col(role) == r, F.col(turn))), F.max(F.when(F.col(role) == r, F.col(turn))))
        for r in ROLES
    ]
    in_order = [a[1] < b[0] for a, b in zip(spans, spans[1:])]
    ok = F.coalesce(reduce(lambda x, y: x & y, in_order, n == len(ROLES)), F.lit(False))
    return turns.groupBy(conversation).agg(n.alias("n_turns"), ok.alias("ok"))


def rejects(df: DataFrame, flag: str, row_id: str = "ord") -> DataFrame:
    """Ids of the rows whose flag is not true."""
    return df.where(~F.coalesce(flag, F.lit(False))).select(row_id)


def gate(df: DataFrame, flag: str, row_id: str = "ord", path: str | None = None) -> None:
    """Fail if any row is rejected; the reject table goes to ``path`` first."""
    bad = rejects(df, flag, row_id)
    if path is not None:
        bad.write.json(path)
        bad = df.sparkSession.read.schema(bad.schema).json(path)
    n = bad.count()
    if n:
        shown = [r[0] for r in bad.orderBy(row_id).limit(20).collect()]
        raise GateError(f"{n} rows rejected on {flag}; first: {shown}")


def assert_none(df: DataFrame, condition: Column, what: str) -> None:
    """Fail if any row meets the condition."""
    if not df.where(condition).limit(1).isEmpty():
        raise GateError(f"unexpected {what}")


def alignment(aligned: DataFrame) -> DataFrame:
    """One row of counts over ``align``: both sides, pairs, rows left alone."""
    return aligned.agg(
        F.count_if("in_gold").alias("n_gold"),
        F.count_if("in_pred").alias("n_pred"),
        F.count_if(F.col("in_gold") & F.col("in_pred")).alias("n_pairs"),
        F.count_if(F.col("in_gold") != F.col("in_pred")).alias("n_alone"),
    )


def over_cap(df: DataFrame, text: str, cap: int) -> DataFrame:
    """Rows in all and rows whose token estimate is above the cap."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(est_tokens(F.col(text)) > cap).alias("n_over"),
    )
