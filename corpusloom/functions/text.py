"""Text normalisers and extractors. Every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters inside a regular expression that starts with (?U). A class
# that lists them one by one is several times slower.
WS = r"[\s\x1c-\x1f]"

CHARS_PER_TOKEN = 3.5
FENCE = "```"


def strip(c: Column) -> Column:
    """Remove white space at both ends (Spark's plain trim knows only U+0020)."""
    return F.trim(c, F.lit(WHITESPACE))


def _strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def _drop_semicolons(c: Column) -> Column:
    return F.rtrim(c, F.lit(";"))


def clean_target(c: Column) -> Column:
    """Target SQL without outer white space and without trailing semicolons."""
    return _strip_end(_drop_semicolons(strip(c)))


def had_semicolon(c: Column) -> Column:
    """True where ``clean_target`` has a trailing semicolon to remove."""
    return strip(c).endswith(";")


def one_blank(c: Column) -> Column:
    """Replace each run of white space by one blank."""
    return F.regexp_replace(c, f"(?U){WS}+", " ")


def collapse_sql(c: Column) -> Column:
    """Collapse white space outside single quotes, then strip and drop ``;``.

    Splitting at the quote leaves the text outside literals at even positions.
    Text without a quote, the common case, skips the array work.
    """
    outside = F.transform(
        F.split(c, "'", -1),
        lambda part, i: F.when(i % 2 == 0, one_blank(part)).otherwise(part),
    )
    collapsed = F.when(c.contains("'"), F.array_join(outside, "'")).otherwise(one_blank(c))
    return strip(_drop_semicolons(strip(collapsed)))


def norm_sql(c: Column) -> Column:
    """Form compared by exact match: one-blank spacing, tight punctuation, upper case."""
    spaced = strip(one_blank(_drop_semicolons(strip(c))))
    # only single blanks are left here: remove those next to punctuation
    return F.upper(F.regexp_replace(spaced, r" (?:(?=[(),=<>])|(?<=[(),=<>] ))", ""))


def mask_backticks(c: Column) -> Column:
    """Replace each backtick-quoted identifier by ``x``."""
    return F.regexp_replace(c, "`[^`]*`", "x")


def db_of(user: Column) -> Column:
    """Database id named on the first line of a user prompt."""
    first_line = F.substring_index(user, "\n", 1)
    return strip(F.replace(first_line, F.lit("Database:"), F.lit("")))


def unfence(c: Column) -> Column:
    """SQL inside the last complete code fence; text without a fence is kept."""
    text = strip(c)
    inside = F.element_at(F.split(text, FENCE, -1), -2)
    body = strip(F.regexp_replace(inside, r"(?s)\A(.*?)sql", "$1"))
    return F.when(text.contains(FENCE), body).otherwise(text)


def question_tail(user: Column, width: int = 120) -> Column:
    """Display form of the question: the first ``width`` characters after ``Question:``."""
    return strip(F.substring(F.substring_index(user, "Question:", -1), 1, width))


def est_tokens(c: Column) -> Column:
    """Token estimate from the number of characters, rounded down."""
    return F.floor(F.length(c) / F.lit(CHARS_PER_TOKEN))
