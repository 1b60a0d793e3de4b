import pytest
from pyspark.sql import functions as F

from corpusloom.functions import prompts as pr
from corpusloom.operators.joins import attach_schema
from corpusloom.plans.jobs import with_schema_text
from corpusloom.sources.readers import CATALOG, last_per_db

SCHEMA = (
    "Tables\n\nt(\n    a,\n    x\n)\n\nu(\n    x\n)\n\nempty(\n    \n)"
    "\n\nForeign Keys\n\nt.x -> u.x\nu.x -> t.a"
)


@pytest.fixture
def catalog(spark):
    columns = [["-1", "*"], ["0", "a"], ["0", "x"], ["1", "x"]]
    return spark.createDataFrame(
        [("d1", ["t", "u", "empty"], columns, [[2, 3], [3, 1]]),
         ("d2", ["t"], [["-1", "*"], ["0", "a"]], [])],
        CATALOG,
    )


def test_render_schema(catalog):
    got = {r["db_id"]: r["schema_text"] for r in with_schema_text(catalog).collect()}
    assert got == {"d1": SCHEMA, "d2": "Tables\n\nt(\n    a\n)"}


def test_bad_foreign_key_fails(spark):
    bad = spark.createDataFrame([("d", ["t"], [["0", "a"]], [[0, 9]])], CATALOG)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        with_schema_text(bad).collect()


def test_last_duplicate_of_a_database_wins(spark):
    rows = spark.createDataFrame([(0, "d", ["old"]), (2, "d", ["new"]), (1, "e", ["x"])],
                                 "ord long, db_id string, table_names_original array<string>")
    got = {r[0]: r[1] for r in last_per_db(rows).collect()}
    assert got == {"d": ["new"], "e": ["x"]}


def test_missing_schema_fails(spark, catalog):
    rows = spark.createDataFrame([("d1",), ("d9",)], "db_id string")
    with pytest.raises(Exception, match="no schema for database d9"):
        attach_schema(rows, with_schema_text(catalog)).collect()


def test_to_chat(spark):
    row = spark.createDataFrame([("d", "S", "  q? ", "SELECT 1")], "d string, s string, q string, a string")
    messages = row.select(pr.to_chat(*map(F.col, "dsqa")).alias("m")).first()["m"]
    assert [m["role"] for m in messages] == ["system", "user", "assistant"]
    assert [m["content"] for m in messages] == [
        "You are an expert SQL generator. Return only executable SQL with no explanation.",
        "Database: d\n\nSchema:\n\nS\n\nQuestion:\nq?\n\nReturn only SQL.",
        "SELECT 1",
    ]


def test_evidence_slot(evaluate):
    def build(evidence):
        return pr.prompt(F.lit("d"), F.lit("S"), F.lit("q"), evidence)

    without = "Database: d\n\nSchema:\n\nS\n\nQuestion:\nq\n\nReturn only SQL."
    with_hint = "Database: d\n\nSchema:\n\nS\n\nEvidence:\nhint\n\nQuestion:\nq\n\nReturn only SQL."
    assert evaluate(build, [None, "", "hint"]) == [without, without, with_hint]


MESSAGES = "messages array<struct<role string, content string>>"


@pytest.mark.parametrize("name, marker", [
    ("im_start", "<|im_start|>assistant\n"),
    ("header_id", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    ("im_sep", "<|im_start|>assistant<|im_sep|>"),
])
def test_render_and_span(spark, name, marker):
    template = pr.TEMPLATES[name]
    assert template.response_marker == marker
    chat = [("system", "s"), ("user", "u"), ("assistant", "a")]
    df = spark.createDataFrame([(chat,)], MESSAGES)
    text = df.select(pr.render_chat("messages", template).alias("t"))
    row = text.select(
        "t", pr.prompt_part(F.col("t"), marker), pr.completion(F.col("t"), marker),
        pr.marker_found(F.col("t"), marker), pr.completion(F.col("t"), "<none>"),
        pr.marker_found(F.col("t"), "<none>"),
    ).first()
    assert row[0] == row[1] + row[2]
    assert row[1].endswith(marker) and row[2] == "a" + template.end
    assert row[3] is True and row[4] is None and row[5] is False


def test_span_takes_the_last_marker(evaluate):
    assert evaluate(lambda c: pr.completion(c, "#"), ["a#b#c"]) == ["c"]
    assert evaluate(lambda c: pr.prompt_part(c, "#"), ["a#b#c", "a#"]) == ["a#b#", "a#"]


def test_roles_and_positions(spark):
    chats = [
        [("system", "s"), ("user", "u"), ("assistant", "a")],
        [("user", "u"), ("system", "s"), ("assistant", "a")],
        [("system", "s"), ("user", "u")],
        [],
        None,
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], f"i int, {MESSAGES}")
    rows = df.select(pr.roles_ok().alias("ok"), pr.message(2).alias("m")).collect()
    assert [r["ok"] for r in rows] == [True, False, False, False, False]
    assert [r["m"] for r in rows] == ["a", "a", None, None, None]
