"""JSON arrays read in blocks: any cut gives the records of a JSON parser."""

import json
import random

import pytest

from corpusloom.sources import arrays, readers

NASTY = ['}', '{', '[', ']', '"', '\\', '\\"', '\\\\', '}, {"a"', '\n', 'é', '🙂', ' ', 'x', ' ', '/', '\\u0022']


def nasty(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 12)))


def questions(rng, n):
    return [{"db_id": f"db{i % 3}", "query": nasty(rng), "question": f"{i} {nasty(rng)}"} for i in range(n)]


@pytest.fixture
def small(spark, monkeypatch):
    """Blocks of some records, several splits for every file."""
    monkeypatch.setattr(arrays, "BLOCK", 200)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent, ascii_", [(None, True), (None, False), (1, False)])
def test_records_of_any_text(spark, small, tmp_path, indent, ascii_):
    rng = random.Random(repr((indent, ascii_)))
    items = questions(rng, 300)
    (tmp_path / "q.json").write_text(json.dumps(items, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    found = arrays.blocks(spark, str(tmp_path / "q.json"))
    assert found.count() > 50 and found.select("start").distinct().count() > 3
    got = readers.read_questions(spark, str(tmp_path / "q.json"), array=True).orderBy("ord").collect()
    assert [(r["ord"], r["db_id"], r["query"], r["question"]) for r in got] == [
        (i, q["db_id"], q["query"], q["question"]) for i, q in enumerate(items)
    ]


def test_every_cut_of_a_text(spark):
    """The effects of two parts compose to that of the whole, for both start states."""
    rng = random.Random(3)
    for _ in range(30):
        body = json.dumps(questions(rng, 3), ensure_ascii=False).encode()
        whole = arrays.marks(body)
        for at in (i for i, b in enumerate(body) if b == arrays.BRACE):
            left, right = arrays.marks(body[:at]), arrays.marks(body[at:])
            for inside in (0, 1):
                depth, lands = arrays.effect(left, inside)
                more, lands_2 = arrays.effect(right, inside ^ left.flips)
                total, lands_all = arrays.effect(whole, inside)
                both = dict(lands)
                for level, n in lands_2:
                    both[level + depth] = both.get(level + depth, 0) + n
                assert (depth + more, both) == (total, dict(lands_all))
                assert left.flips ^ right.flips == whole.flips


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    items = [{"db_id": "d", "query": "q" * 100, "question": str(i)} for i in range(120_000)]
    (tmp_path / "q.json").write_text(json.dumps(items))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = arrays.blocks(spark, str(tmp_path / "q.json"))
        assert found.select("start").distinct().count() > 3 and found.count() > 12
        rows = readers.read_questions(spark, str(tmp_path / "q.json"), array=True)
        assert rows.where("ord = question").count() == len(items)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_in_natural_order_and_empty_arrays(spark, small, tmp_path):
    rng = random.Random(5)
    parts = {f"part-{i}.json": questions(rng, n) for i, n in ((2, 7), (10, 40), (3, 0), (1, 1))}
    for name, items in parts.items():
        (tmp_path / name).write_text("﻿ " * (name == "part-2.json") + json.dumps(items) + "\n")
    got = readers.read_questions(spark, str(tmp_path), array=True).orderBy("ord").collect()
    expected = [q for name in ("part-1.json", "part-2.json", "part-3.json", "part-10.json") for q in parts[name]]
    assert [r["question"] for r in got] == [q["question"] for q in expected]
    assert [r["ord"] for r in got] == list(range(48))


def test_nested_objects_and_large_records(spark, small, tmp_path):
    items = [{"db_id": str(i), "table_names_original": ["a}", "b]"] * (200 if i == 3 else 1), "column_names_original": [[0, "{"]],
              "foreign_keys": [[1, 2]], "more": {"x": {"y": [{}, {"z": "}"}]}}} for i in range(12)]
    (tmp_path / "c.json").write_text(json.dumps(items))
    got = readers.read_catalog(spark, str(tmp_path / "c.json"), array=True).orderBy(arrays.F.col("db_id").cast("int")).collect()
    assert [r["db_id"] for r in got] == [str(i) for i in range(12)]
    assert len(got[3]["table_names_original"]) == 400 and got[4]["foreign_keys"] == [[1, 2]]


BROKEN = {
    "a missing quote": (lambda t: t.replace('"question": "70', '"question": 70', 1), "record 7[01]"),
    "a missing comma": (lambda t: t.replace('}, {"db_id": "db1", "query": "q70"', '} {"db_id": "db1", "query": "q70"', 1), "record 70"),
    "a lost brace": (lambda t: t.replace('"query": "q70", "question": "70"}', '"query": "q70", "question": "70"', 1), "record"),
    "no end": (lambda t: t[:-1], "record (99|100)"),
    "an end too early": (lambda t: t + "]", "record"),
    "text behind": (lambda t: t + " x", "record 100"),
    "lines": (lambda t: t[1:-1].replace("}, {", "}\n{"), "record 0"),
    "no object": (lambda t: t.replace('[{', '[7, {', 1), "record 0"),
    "a missing field": (lambda t: t.replace('"query": "q70", ', "", 1), "no query at line 70"),
    "a wrong type of JSON": (lambda t: t.replace('"question": "70"', '"question": "70", "a" "b"', 1), "record 70"),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_files_fail_with_the_record(spark, small, tmp_path, name):
    items = [{"db_id": f"db{i % 3}", "query": f"q{i}", "question": f"{i} }} ]"} for i in range(100)]
    spoil, said = BROKEN[name]
    text = json.dumps(items)
    if "question\": \"70\"" not in text:
        text = text.replace('"question": "70 } ]"', '"question": "70"')
    spoilt = spoil(text)
    assert spoilt != text
    (tmp_path / "q.json").write_text(spoilt)
    with pytest.raises(Exception, match=said):
        readers.read_questions(spark, str(tmp_path / "q.json"), array=True).collect()
