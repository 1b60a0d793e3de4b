"""Quality rules as a short-circuit cascade.

A document is rejected by the first rule that fails it. Which rule runs first
matters for the cost only, never for the verdict, so the order may come from a
measurement: every rule is timed alone on a sample of documents, several times in
turn, and its cost is the median, to the next power of two, as finer differences
are noise. The sample also shows which documents each rule rejects, and the
cascade takes the rule with the most rejections per second among the documents
still undecided, then repeats; equal ones keep the order given. ``CASE WHEN``
evaluates lazily, so a later rule costs nothing for a
rejected document.

Everything is built-in expressions over one row; nothing shuffles. Null text
is an empty text: no words, so ``few_words`` rejects it. Repeated rows are
judged row by row. An empty table gives an empty result with rules in the
order given.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import let, packed, words
from corpusloom.sources.staging import stage

Metric = Callable[[Column], Column]
SAMPLE_ROWS = 1000
# Timed jobs per rule, the first of which warms up, and times a job takes the sample.
TURNS = 4
TIMES = 3


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.length(F.array_join(words(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _windows(tokens: Column) -> Column:
    """All 3-word windows; words hold no blank, so a blank joins them safely."""
    start = F.when(F.size(tokens) >= 3, F.sequence(F.lit(0), F.size(tokens) - 3))
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.transform(start, lambda i: F.concat_ws(" ", tokens[i], tokens[i + 1], tokens[i + 2])), none
    )


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more. Sorting brings equal
    windows together, so a text of n words costs n log n."""

    def count(ranked: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ranked) - 1)

        def same(k: Column, other: Column) -> Column:
            return F.coalesce(F.get(ranked, other)["w"] == ranked[k]["w"], F.lit(False))

        repeated = F.filter(at, lambda k: same(k, k - 1) | same(k, k + 1))
        places = F.transform(
            repeated, lambda k: F.array(ranked[k]["i"], ranked[k]["i"] + 1, ranked[k]["i"] + 2)
        )
        return F.size(F.array_distinct(F.flatten(places)))

    pairs = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return let(F.sort_array(pairs), count)


def n_repeat_words(text: Column) -> Column:
    """Words in 3-word windows found twice or more, the first one included."""

    def of(windows: Column) -> Column:
        plain = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(plain, F.lit(0)).otherwise(_covered(windows))

    return let(words(text), lambda w: let(_windows(w), of)).cast("long")


METRICS: dict[str, Metric] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the metrics named in ``needs`` and returns a boolean."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]

    def on(self, get: Callable[[str], Column]) -> Column:
        return F.coalesce(self.rejects(*[get(n) for n in self.needs]), F.lit(False))


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > 3 * n),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 30 * n),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
)


def _from_text(text: Column) -> Callable[[str], Column]:
    return lambda name: METRICS[name](text)


def sample_of(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts from all over the table, staged."""
    total = docs.count()
    return stage(docs.select(text).sample(min(1.0, rows / max(total, 1)), seed=17))


def _seconds(frame: DataFrame) -> float:
    start = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def costs(sample: DataFrame, text: str, verdicts: Sequence[Column]) -> list[float]:
    """Seconds each verdict takes on the sample, as a power of two."""
    several = sample.select(text, F.explode(F.sequence(F.lit(1), F.lit(TIMES))))
    jobs = [several.select(F.length(text).alias("n")), *[several.select(v) for v in verdicts]]
    turns = [[_seconds(job) for job in jobs] for _ in range(TURNS)][1:]
    idle, *each = (median(times) for times in zip(*turns))
    return [2.0 ** math.ceil(math.log2(max(seconds - idle, 2.0**-9))) for seconds in each]


def plan(sample: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> list[str]:
    """Names of the rules, most rejections per second first.

    The rejections come back as counts per combination of verdicts, so what a
    rule still rejects after those before it is exact for the sample.
    """
    get = _from_text(F.col(text))
    verdicts = [rule.on(get).cast("int").alias(f"v{i}") for i, rule in enumerate(rules)]
    counted = sample.select(*verdicts).groupBy(*[f"v{i}" for i in range(len(rules))]).count().collect()
    cost = costs(sample, text, verdicts)
    order, rest, undecided = [], list(range(len(rules))), counted
    while rest:
        def gain(i: int) -> float:
            return sum(r["count"] for r in undecided if r[f"v{i}"]) / cost[i]

        best = max(rest, key=lambda i: (gain(i), -i))
        order.append(rules[best].name)
        rest.remove(best)
        undecided = [r for r in undecided if not r[f"v{best}"]]
    return order


def rejected_by(
    order: Sequence[str], rules: Sequence[Rule], get: Callable[[str], Column]
) -> Column:
    """Name of the first rule in ``order`` that rejects, null if none does."""
    by_name = {rule.name: rule for rule in rules}
    verdict = None
    for name in order:
        test = by_name[name].on(get)
        verdict = F.when(test, F.lit(name)) if verdict is None else verdict.when(test, F.lit(name))
    return F.lit(None).cast("string") if verdict is None else verdict


def keep(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    order = plan(sample_of(docs, text), text, rules)
    judged = packed(docs, verdict=rejected_by(order, rules, _from_text(docs[f"`{text}`"])))
    return judged.where(F.col("verdict").isNull()).select("row.*")


def report(docs: DataFrame, key: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per document its key, all metrics, ``base_failed`` and ``kept``."""
    order = plan(sample_of(docs, text), text, rules)
    body = docs[f"`{text}`"]
    tokens = docs.select(docs[f"`{key}`"].alias("key"), body.alias("text"), words(body).alias("words"))
    windows = tokens.select("key", "text", "words", _windows(F.col("words")).alias("windows"))
    distinct = F.size(F.array_distinct("windows")) == F.size("windows")
    metrics = windows.select(
        F.col("key").alias(key),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        _lines(F.col("text")).alias("lines"),
        F.when(distinct, F.lit(0)).otherwise(_covered(F.col("windows"))).cast("long").alias("n_repeat_words"),
    )
    counted = metrics.select(
        key, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.size("lines").cast("long").alias("n_lines"),
    )
    failed = [rule.on(F.col) for rule in BASE_RULES]
    return counted.select(
        *[c for c in counted.columns if c != "n_lines"],
        (failed[0] | failed[1]).alias("base_failed"),
        rejected_by(order, rules, F.col).isNull().alias("kept"),
    )
