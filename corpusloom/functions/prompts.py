"""Chat records: schema text, prompts, rendered conversations and their parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import strip

# Prompt constants and the order of roles in a record.
SYSTEM_PROMPT = (
    "You are an expert SQL generator. Return only executable SQL with no explanation."
)
ROLES = ("system", "user", "assistant")


@dataclass(frozen=True)
class ChatTemplate:
    """Text around a message: ``before + role + after + content + end``."""

    before: str
    after: str
    end: str

    @property
    def response_marker(self) -> str:
        """The text after which the assistant's answer starts."""
        return f"{self.before}assistant{self.after}"


# The three message formats in use.
TEMPLATES = {
    "im_start": ChatTemplate("<|im_start|>", "\n", "<|im_end|>\n"),
    "header_id": ChatTemplate("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"),
    "im_sep": ChatTemplate("<|im_start|>", "<|im_sep|>", "<|im_end|>"),
}


def message(i: int, messages: str | Column = "messages") -> Column:
    """Content of the i-th message; null where the record is too short."""
    return F.get(messages, F.lit(i))["content"]


def roles_ok(messages: str | Column = "messages") -> Column:
    """True where the record is exactly system, user, assistant."""
    found = F.transform(messages, lambda m: m["role"])
    return F.coalesce(found.eqNullSafe(F.array(*map(F.lit, ROLES))), F.lit(False))


def render_schema(tables: Column, columns: Column, fks: Column) -> Column:
    """Schema text: one block per table, then one line per foreign key.

    ``columns`` holds [table index, name] pairs of strings; index -1 is the
    ``*`` pseudo column and belongs to no table. ``fks`` holds pairs of
    positions in ``columns``.
    """

    def block(table: Column, i: Column) -> Column:
        own = F.filter(columns, lambda col: col[0].cast("int") == i)
        names = F.array_join(F.transform(own, lambda col: col[1]), ",\n    ")
        return F.concat(table, F.lit("(\n    "), names, F.lit("\n)"))

    def endpoint(position: Column) -> Column:
        pair = F.element_at(columns, position.cast("int") + 1)
        table = F.element_at(tables, pair[0].cast("int") + 1)
        return F.concat(table, F.lit("."), pair[1])

    blocks = F.concat(
        F.lit("Tables\n\n"), F.array_join(F.transform(tables, block), "\n\n")
    )
    arrows = F.transform(
        fks, lambda fk: F.concat(endpoint(fk[0]), F.lit(" -> "), endpoint(fk[1]))
    )
    keys = F.concat(F.lit("\n\nForeign Keys\n\n"), F.array_join(arrows, "\n"))
    return F.concat(blocks, F.when(F.size(fks) > 0, keys).otherwise(F.lit("")))


def prompt(db: Column, schema: Column, question: Column, evidence: Column | None = None) -> Column:
    """User prompt; the evidence part appears only where evidence is not empty."""
    hint = F.lit("")
    if evidence is not None:
        hint = F.when(
            evidence.isNotNull() & (evidence != ""),
            F.concat(F.lit("\n\nEvidence:\n"), evidence),
        ).otherwise(F.lit(""))
    return F.concat(
        F.lit("Database: "), db,
        F.lit("\n\nSchema:\n\n"), schema, hint,
        F.lit("\n\nQuestion:\n"), question,
        F.lit("\n\nReturn only SQL."),
    )


def chat(*contents: Column) -> Column:
    """Messages array from one content per role, in role order."""
    return F.array(*[
        F.struct(F.lit(role).alias("role"), content.alias("content"))
        for role, content in zip(ROLES, contents, strict=True)
    ])


def to_chat(db: Column, schema: Column, question: Column, sql: Column) -> Column:
    """Training record of a question: system prompt, user prompt, target SQL."""
    return chat(F.lit(SYSTEM_PROMPT), prompt(db, schema, strip(question)), sql)


def render_chat(messages: str | Column, template: ChatTemplate) -> Column:
    """One training text per record."""
    parts = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(template.before), m["role"], F.lit(template.after),
            m["content"], F.lit(template.end),
        ),
    )
    return F.array_join(parts, "")


def marker_found(text: Column, marker: str) -> Column:
    """False where training on the completion would silently learn nothing."""
    return text.contains(marker)


def completion(text: Column, marker: str) -> Column:
    """Text after the last marker; null without a marker."""
    return F.when(text.contains(marker), F.substring_index(text, marker, -1))


def prompt_part(text: Column, marker: str) -> Column:
    """Text up to and including the last marker; null without a marker."""
    keep = F.length(text) - F.length(F.substring_index(text, marker, -1))
    return F.when(text.contains(marker), F.substring(text, F.lit(1), keep))
