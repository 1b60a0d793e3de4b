"""Structure of SQL text: the exclusive bucket and the non-exclusive feature flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import WS

# Buckets in classification order (first match wins).
BUCKETS = (
    "set_op",
    "nested",
    "having",
    "multi_join",
    "group_by",
    "single_join",
    "single_table_analytic",
    "simple",
)
# Feature flags in report order.
FEATURES = ("join", "group_by", "having", "order_by", "agg", "nested", "set_op", "window")
# Keyword lists.
SET_OPERATORS = ("UNION", "INTERSECT", "EXCEPT")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def padded(sql: Column) -> Column:
    """Upper-case text with a blank at both ends, the form all tests below expect."""
    return F.concat(F.lit(" "), F.upper(sql), F.lit(" "))


def _times(s: Column, token: str) -> Column:
    """Number of non-overlapping occurrences of ``token``."""
    removed = F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))
    return removed / F.lit(len(token))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# A plain substring test runs before each regular expression: it is far cheaper
# and false for most rows. (?U) makes \b treat letters as Python does.
def _word(s: Column, word: str) -> Column:
    return s.contains(word) & s.rlike(rf"(?U)\b{word}\b")


def _call(s: Column, names) -> Column:
    return _any(s.contains(n) for n in names) & s.rlike(rf"(?U)\b(?:{'|'.join(names)}){WS}*\(")


def _has_set_op(s: Column) -> Column:
    return _any(_word(s, w) for w in SET_OPERATORS)


def bucket_of(s: Column) -> Column:
    """Exclusive bucket of ``padded`` text."""
    joins = _times(s, " JOIN ")
    tests = {
        "set_op": _has_set_op(s),
        "nested": _times(s, "SELECT") >= 2,
        "having": _word(s, "HAVING"),
        "multi_join": joins >= 2,
        "group_by": _word(s, "GROUP BY"),
        "single_join": joins == 1,
        "single_table_analytic": _call(s, AGGREGATES) | _word(s, "ORDER BY"),
    }
    chain = F
    for name in BUCKETS[:-1]:
        chain = chain.when(tests[name], name)
    return chain.otherwise(BUCKETS[-1])


def flags_of(s: Column) -> dict[str, Column]:
    """The non-exclusive flags of ``padded`` text, by name."""
    return {
        "join": s.contains(" JOIN "),
        "group_by": _word(s, "GROUP BY"),
        "having": _word(s, "HAVING"),
        "order_by": _word(s, "ORDER BY"),
        "agg": _call(s, AGGREGATES),
        "nested": _times(s, "SELECT") >= 2,
        "set_op": _has_set_op(s),
        "window": uses_window(s),
    }


def uses_window(s: Column) -> Column:
    """True where ``padded`` text calls a window function."""
    return _call(s, ("OVER",))


def with_bucket(df: DataFrame, sql: str, out: str = "bucket") -> DataFrame:
    """Add the bucket of column ``sql``.

    The padded text is a column of its own, so it is computed once per row
    and not once per test.
    """
    return df.withColumn("_padded", padded(F.col(sql))).withColumn(
        out, bucket_of(F.col("_padded"))
    ).drop("_padded")


def with_features(df: DataFrame, sql: str) -> DataFrame:
    """Add one boolean column ``has_<feature>`` per feature of column ``sql``."""
    flags = flags_of(F.col("_padded"))
    return df.withColumn("_padded", padded(F.col(sql))).withColumns(
        {f"has_{name}": flags[name] for name in FEATURES}
    ).drop("_padded")
