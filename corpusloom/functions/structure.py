"""Structural gate for SQL text.

It tests what can be seen without a grammar: quotes, brackets and comments are
closed, parentheses balance, the text begins with a statement's verb, and no
select list is empty. Comments and quoted text are told apart in one scan from the
left, as each may hold the other's marks; the tests then see plain text only.
Text that passes need not be valid SQL; a caller with a parser of their own
can hand its verdict to the jobs instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Words a statement may begin with.
VERBS = (
    "SELECT", "WITH", "VALUES", "INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE",
    "CREATE", "ALTER", "DROP", "EXPLAIN", "PRAGMA",
)
QUOTED = "`[^`]*+`|'(?:[^']++|'')*+'|\"(?:[^\"]++|\"\")*+\"|\\[[^\\]]*+\\]"
COMMENT = "--[^\\n\\r]*+|/\\*(?:[^*]++|\\*(?!/))*+\\*/"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def without_comments(sql: Column) -> Column:
    """Blanks in place of comments; what looks like one inside quotes stays."""
    some = F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*"))
    return F.when(some, F.regexp_replace(sql, f"({QUOTED})|{COMMENT}", "$1 ")).otherwise(sql)


def without_literals(sql: Column) -> Column:
    """Quoted text replaced by a name, so that only open quotes are left."""
    return F.regexp_replace(sql, QUOTED, "x")


def bare(sql: Column) -> Column:
    """The text without comments and quoted text."""
    return without_literals(without_comments(sql))


def balanced(sql: Column) -> Column:
    """Whether parentheses close in order."""
    marks = F.filter(F.split(F.regexp_replace(sql, "[^()]++", ""), ""), lambda c: c != "")

    def step(state: Column, mark: Column) -> Column:
        depth = state["depth"] + F.when(mark == "(", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(state["low"], depth).alias("low"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    folded = F.aggregate(marks, start, step, lambda s: (s["depth"] == 0) & (s["low"] == 0))
    none = ~F.contains(sql, F.lit("(")) & ~F.contains(sql, F.lit(")"))
    return F.when(none, F.lit(True)).otherwise(folded)


def statements(sql: Column) -> Column:
    """Number of statements: pieces between semicolons that hold anything."""
    return F.size(F.filter(F.split(bare(sql), ";"), lambda piece: F.rlike(piece, F.lit("\\S"))))


def structure_ok(sql: Column) -> Column:
    """True where the text has the structure of a statement; false for null."""

    def sound(text: Column) -> Column:
        verb = F.rlike(text, F.lit(rf"(?i)^[\s(]*+(?:{'|'.join(VERBS)})\b"))
        open_mark = F.rlike(text, F.lit(r"['\"`\[\]]|/\*"))
        empty_list = F.rlike(text, F.lit(
            r"(?i)\bSELECT\s*+(?:(?:DISTINCT|ALL)\b\s*+)?(?:$|[,;)]|(?:FROM|WHERE|GROUP|HAVING|ORDER|LIMIT)\b)"
        ))
        return F.when(~verb | open_mark | empty_list, F.lit(False)).otherwise(balanced(text))

    return F.coalesce(_let(bare(sql), sound), F.lit(False))
