"""Personal data: patterns, and words that give protected entities away.

*Base spans.* Emails, IP addresses, card and phone numbers by pattern and
check digit. Offsets are code points: the pieces between the matches and the
matches add up to them, so no text is searched twice. The patterns are written
so that they neither recurse nor rescan a long run of one kind of character,
and positions are summed in blocks, so the cost of a text grows with its length
however many matches it has.

*Disclosing terms.* An entity is the value of a base span, or what its value
belongs to: the mail domain, the network, the card's issuer, the block of phone
numbers. Its information content is ``IC = -log2(df / N)``; a term of the same
text has ``PMI = log2(N * n / (df_entity * df_term))``. ``N``, ``n`` and both
frequencies count different texts, so copies of one text count once on every
side. A term with ``PMI >= GENERALISE * IC`` tells most of what the entity would
tell and is generalised in every document that holds the term, with the entity
or without it; with ``PMI >= REMOVE * IC`` it is removed. ``SUPPORT`` texts are
needed for evidence, ``GROUP_SUPPORT`` for a value that stands for many.

All of it is built-in expressions and joins. An entity meets all terms of its
texts outside base spans, after exact bounds have removed most of both. ``n`` is
at most ``df_entity``, so an entity needs its support; a share of ``GENERALISE``
needs ``df_term <= N ** (1 - GENERALISE) * df_entity ** GENERALISE``, and the
frequency among texts with base spans is already too high for common terms. The
entities of one text are dealt to blocks, so a directory of addresses is no
single task. Null text is an empty text; repeated rows are judged alike; rows
with a null key are treated like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import let, packed
from corpusloom.operators.joins import lookup_join
from corpusloom.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
# a match starts where its run of characters or the search starts; a run of
# fewer than 14 digits holds no card
PATTERNS = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){13,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
# a text without this cannot match
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = "[\\p{L}\\p{N}]{3,}"

SUPPORT = 3
GROUP_SUPPORT = 10
GENERALISE = 0.8
REMOVE = 0.95

# Items of an array that are summed in one go, code points of a piece of text,
# entities of a text that meet its terms in one task.
BLOCK = 128
PIECE = 4096
ENTITIES = 64

SPAN = "struct<start: int, no: int, kind: string, end: int, value: string>"


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(i % 2 == 1, doubled).otherwise(digit)

    places = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value)
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``merge`` of every prefix of an array of integers from 0 up. An array
    that grows by one item is copied each time, so only short ones do."""
    none = F.array().cast("array<int>")

    def prefixes(part: Column, start: Column) -> Column:
        def add(done: Column, x: Column) -> Column:
            at = merge(done["at"], x)
            return F.struct(at.alias("at"), F.concat(done["out"], F.array(at)).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), add, lambda done: done["out"])

    def blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))
        totals = F.transform(starts, lambda i: F.aggregate(F.slice(all_, i, F.lit(BLOCK)), F.lit(0), merge))
        return let(prefixes(totals, F.lit(0)), lambda before: F.flatten(F.transform(starts, lambda i, b: prefixes(
            F.slice(all_, i, F.lit(BLOCK)), F.when(b == 0, F.lit(0)).otherwise(F.get(before, b - 1))
        ))))

    return let(values, lambda all_: F.when(F.size(all_) == 0, none)
               .when(F.size(all_) <= BLOCK, prefixes(all_, F.lit(0))).otherwise(blocks(all_)))


def _located(text: Column, pattern: str, no: int, kind: str) -> Column:
    """All matches as spans, from the lengths of matches and gaps."""
    none = F.array().cast(f"array<{SPAN}>")

    def span(end: Column, match: Column) -> Column:
        start = end - F.length(match)
        return F.struct(
            start.alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), end.alias("end"),
            match.alias("value"),
        )

    def spans(matches: Column, gaps: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(gaps[i]))
        ends = running(lengths, lambda a, b: a + b)
        return let(ends, lambda end: F.transform(matches, lambda m, i: span(end[i], m)))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(
            let(F.split(text, pattern, -1), lambda gaps: spans(m, gaps))
        ),
    )


def base_spans(text: Column) -> Column:
    """Base spans of one text, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(no: int, kind: str) -> Column:
        passing = F.filter(_located(text, PATTERNS[kind], no, kind), lambda s: _passes(kind, s["value"]))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), passing).otherwise(none)

    return F.sort_array(F.concat(*[of(no, kind) for no, kind in enumerate(KINDS)]))


def _entities(span: Column) -> Column:
    """The value of a span and the group it belongs to."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    plain = F.when(span["no"] >= 2, digits).otherwise(F.lower(span["value"]))
    group = (
        F.when(span["no"] == 0, F.concat(F.lit("domain:"), F.substring_index(plain, "@", -1)))
        .when(span["no"] == 1, F.concat(F.lit("network:"), F.substring_index(plain, ".", 3)))
        .when(span["no"] == 2, F.concat(F.lit("issuer:"), F.substring(plain, 1, 6)))
        .otherwise(F.concat(F.lit("block:"), F.substring(plain, F.lit(1), F.length(plain) - 4)))
    )
    return F.array(F.concat_ws(":", span["kind"], plain), group)


def _rewritten(text: Column, spans: Column, written: Callable[[Column, Column, Callable], Column]) -> Column:
    """The text with ``written(span, at, cut)`` in place of every span; ``at`` is
    the end of the spans before, ``cut`` takes code points out of the text."""

    def whole(pieces: Column, all_: Column, reached: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            around = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.when(b <= a, F.lit("")).otherwise(F.substring(around, a - first * PIECE + 1, b - a))

        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(reached, i - 1))
            return let(before, lambda at: F.concat(cut(at, s["start"]), written(s, at, cut)))

        return F.concat(F.array_join(F.transform(all_, piece), ""), cut(F.element_at(reached, -1), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda all_: let(
        running(F.transform(all_, lambda s: s["end"]), lambda a, b: F.greatest(a, b)),
        lambda reached: let(pieces, lambda p: whole(p, all_, reached)),
    )))


def _term_text(text: Column, base: Column) -> Column:
    """The text in lower case with blanks in place of base spans, as long as
    before: of all letters only the dotted capital I would grow."""

    def blank(s: Column, at: Column, cut: Callable) -> Column:
        return F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"])))

    return F.lower(F.translate(_rewritten(text, base, blank), "\u0130", "i"))


def _own_terms(text: Column, base: Column) -> Column:
    """Different terms of a text outside its base spans."""
    return F.array_distinct(F.regexp_extract_all(_term_text(text, base), F.lit(TERM), F.lit(0)))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, digest, text``; a null text is an empty one."""
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    return docs.select(docs[f"`{key}`"].alias("key"), F.md5(body.cast("binary")).alias("digest"), body.alias("text"))


def found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, digest, base, own`` of every row; its own terms only where there are
    base spans. Staged."""
    rows = _texts(docs, key, text).select("key", "digest", "text", base_spans(F.col("text")).alias("base"))
    some = F.size("base") > 0
    return stage(rows.select(
        "key", "digest", "base", F.when(some, _own_terms(F.col("text"), F.col("base"))).alias("own"),
    ))


def _support(entity: Column) -> Column:
    return F.when(entity.rlike("^(domain|network|issuer|block):"), GROUP_SUPPORT).otherwise(SUPPORT)


def candidates(held: DataFrame, total: int) -> DataFrame:
    """``entity, df_entity, term, n`` of pairs that may tell enough, by what the
    texts with base spans say alone. Staged."""
    copies = held.where(F.size("base") > 0).select("digest", "base", "own").groupBy("digest")
    holders = stage(copies.agg(F.first("base").alias("base"), F.first("own").alias("terms")).select(
        "digest", F.array_distinct(F.flatten(F.transform("base", _entities))).alias("entities"), "terms"
    ).withColumn("blocks", F.ceil(F.size("entities") / ENTITIES).cast("int")))
    owners = holders.select("digest", "blocks", F.explode("entities").alias("entity"))
    entities = stage(
        owners.groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
        .where(F.col("df_entity") >= _support(F.col("entity")))
    )
    largest = entities.agg(F.max("df_entity")).first()[0]
    if largest is None:
        return held.sparkSession.createDataFrame([], "entity string, df_entity long, term string, n long")
    n = F.lit(float(total))

    def rare(df_term: Column, df_entity: Column) -> Column:
        # a little more than the bound, as the share is tested at last
        return df_term <= 1.000001 * F.pow(n, F.lit(1 - GENERALISE)) * F.pow(df_entity, F.lit(GENERALISE))

    block = F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int").alias("block")
    of = stage(lookup_join(owners, entities, ["entity"], staged=True).select("digest", block, "entity", "df_entity"))
    judged = lookup_join(holders, of.select("digest").distinct(), ["digest"], "left_semi")
    spoken = holders.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("m"))
    least = min(SUPPORT, GROUP_SUPPORT)
    terms = stage(spoken.where((F.col("m") >= least) & rare(F.col("m").cast("double"), F.lit(float(largest)))))
    owned = lookup_join(judged.select("digest", "blocks", F.explode("terms").alias("term")), terms, ["term"], staged=True)
    dealt = owned.select("digest", "term", "m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # at most ENTITIES or so of a text meet its terms in one group
    together = (
        of.join(dealt, ["digest", "block"])
        .where(rare(F.col("m").cast("double"), F.col("df_entity").cast("double")))
        .groupBy("entity", "df_entity", "term", "m")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the share needs n / df_term >= (df_entity / N) ** (1 - GENERALISE), and df_term is m at least
    enough = F.col("n") * 1.000001 >= F.col("m") * F.pow(F.col("df_entity") / n, F.lit(1 - GENERALISE))
    return stage(
        together.where((F.col("n") >= _support(F.col("entity"))) & enough).select("entity", "df_entity", "term", "n")
    )


def mentions(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``key, digest, term``: which of the given terms each row's text holds.
    Staged."""
    rows = _texts(docs, key, text)
    own = rows.select("key", "digest", F.explode(_own_terms(F.col("text"), base_spans(F.col("text")))).alias("term"))
    return stage(lookup_join(own, terms, ["term"]))


def _shares(pairs: DataFrame, said: DataFrame, total: int) -> DataFrame:
    """``entity, term, share`` of the pairs that tell at least ``GENERALISE``."""
    frequency = said.groupBy("term").agg(F.count_distinct("digest").alias("df"))
    n = F.lit(float(total))
    ic = -F.log2(F.col("df_entity") / n)
    pmi = F.log2(n * F.col("n") / (F.col("df_entity") * F.col("df")))
    scored = lookup_join(pairs, frequency, ["term"]).withColumn("share", F.try_divide(pmi, ic))
    return stage(scored.where(F.col("share") >= GENERALISE).select("entity", "term", "share"))


def _different(held: DataFrame) -> int:
    return held.select("digest").distinct().count()


def disclosures(docs: DataFrame, text: str, held: DataFrame) -> DataFrame:
    """``entity, term, share`` for terms that tell at least ``GENERALISE`` of an
    entity's information; ``share`` is PMI / IC."""
    total = _different(held)
    pairs = candidates(held, total)
    return _shares(pairs, mentions(docs, text, text, pairs.select("term").distinct()), total)


def term_spans(docs: DataFrame, key: str, text: str, held: DataFrame) -> DataFrame | None:
    """``key, digest, extra``: spans of disclosing terms of every document that
    holds any; ``None`` if there are none. Staged."""
    total = _different(held)
    pairs = candidates(held, total)
    if pairs.isEmpty():
        return None
    said = mentions(docs, key, text, pairs.select("term").distinct())
    told = stage(_shares(pairs, said, total).groupBy("term").agg(F.max("share").alias("share")))
    if told.isEmpty():
        return None
    # of a row the terms it holds, as a set: repeated rows hold the same
    hit = lookup_join(said, told, ["term"], staged=True).groupBy("key", "digest").agg(
        F.collect_set(F.struct("term", "share")).alias("own")
    )
    rows = lookup_join(_texts(docs, key, text), hit, ["key", "digest"])
    plain = rows.select("key", "digest", "own", _term_text(F.col("text"), base_spans(F.col("text"))).alias("plain"))
    spans = plain.select("key", "digest", "own", _located(F.col("plain"), TERM, 4, "generalise").alias("spans"))
    told_here = F.filter("spans", lambda s: F.array_contains(F.col("own.term"), s["value"]))
    named = spans.select("key", "digest", "own", told_here.alias("spans")).select(
        "key", "digest", F.transform("spans", lambda s: _named(s, F.map_from_entries("own"))).alias("extra")
    )
    # rows that are repeated have the same spans
    return stage(named.groupBy("key", "digest").agg(F.first("extra").alias("extra")))


def _named(span: Column, share: Column) -> Column:
    """The span of a term by what becomes of it."""
    removed = F.try_element_at(share, span["value"]) >= REMOVE
    return F.struct(
        span["start"].alias("start"),
        F.when(removed, 5).otherwise(4).alias("no"),
        F.when(removed, F.lit("remove")).otherwise(F.lit("generalise")).alias("kind"),
        span["end"].alias("end"),
        span["value"].alias("value"),
    )


def _with_extra(rows: DataFrame, extra: DataFrame | None) -> DataFrame:
    """Rows ``key, digest, ...`` with the term spans of their documents."""
    if extra is None:
        return rows.withColumn("extra", F.lit(None).cast(f"array<{SPAN}>"))
    return lookup_join(rows, extra, ["key", "digest"], "left", staged=True)


def _all_spans(base: Column, extra: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.sort_array(F.concat(base, F.coalesce(extra, none)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced; overlapping spans go together."""

    def fresh(s: Column, at: Column, cut: Callable) -> Column:
        said = cut(s["start"], s["end"])
        general = (
            F.when(said.rlike("^\\p{N}+$"), F.lit("<NUMBER>"))
            .when(said.rlike("^\\p{Lu}"), F.lit("<NAME>"))
            .otherwise(F.lit("<WORD>"))
        )
        return (
            F.when((s["start"] < at) | (s["kind"] == "remove"), F.lit(""))
            .when(s["kind"] == "generalise", general)
            .otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        )

    return _rewritten(text, spans, fresh)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts per kind, digest of the base spans, all spans."""
    held = found(docs, key, text)
    rows = _with_extra(held.select("key", "digest", "base"), term_spans(docs, key, text, held))
    spans = _all_spans(F.col("base"), F.col("extra"))
    count = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    return rows.select(
        F.col("key").alias(key),
        *[count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
    )


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The documents with personal data replaced in ``text``; ``n_chars`` names
    a column that holds the length of the text, if there is one."""
    extra = term_spans(docs, key, text, found(docs, key, text))
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    whole = packed(docs, key=docs[f"`{key}`"], digest=F.md5(body.cast("binary")), body=body)
    spanned = _with_extra(whole, extra).select("row", "body", "extra", base_spans(F.col("body")).alias("base"))
    spans = spanned.select("row", "body", _all_spans(F.col("base"), F.col("extra")).alias("spans"))
    clean = spans.select("row", F.when(F.size("spans") > 0, redacted(F.col("body"), F.col("spans"))).alias("clean"))
    columns = []
    for name in docs.columns:
        old = F.col("row")[name]
        if name == text:
            old = F.coalesce("clean", old)
        elif name == n_chars:
            old = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return clean.select(*columns)
