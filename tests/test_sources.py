import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.prompts import message
from corpusloom.operators import joins
from corpusloom.sources import readers
from corpusloom.sources.readers import read_predictions
from corpusloom.sources.staging import purge, shared_folder, stage
from corpusloom.sources.writers import write_jsonl, write_lines, write_summary


def chat_line(i):
    turns = zip(("system", "user", "assistant"), ("s", f"Database: d{i}\n\né", f"SELECT {i}"))
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in turns]})


@pytest.fixture
def small_splits(spark):
    """Cut even small files into many input splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "2048")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("table_rows", [1_000_000, 1])
def test_line_order_over_files_and_splits(spark, tmp_path, small_splits, monkeypatch, table_rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", table_rows)
    # the first file in name order is the smallest one
    sizes = {"a": 3, "b": 400, "c": 120}
    i = 0
    for name, n in sizes.items():
        lines = [chat_line(i + k) for k in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        i += n
    df = readers.read_chat(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 5
    got = {r["ord"]: r["sql"] for r in df.select("ord", message(2).alias("sql")).collect()}
    assert got == {k: f"SELECT {k}" for k in range(sum(sizes.values()))}


@pytest.mark.parametrize("before, after", [(1, 16), (16, 3)])
def test_numbers_outlive_a_change_of_layout(spark, tmp_path, before, after):
    name = "spark.sql.files.minPartitionNum"
    n = 200_000
    (tmp_path / "p.jsonl").write_text("".join(f'{{"sql": "SELECT {i}"}}\n' for i in range(n)))
    try:
        spark.conf.set(name, before)
        df = readers.read_predictions(spark, str(tmp_path))
        spark.conf.set(name, after)
        wrong = df.where(F.col("sql") != F.concat(F.lit("SELECT "), F.col("ord"))).count()
        assert (df.count(), df.select("ord").distinct().count(), wrong) == (n, n, 0)
    finally:
        spark.conf.unset(name)


def test_part_numbers_are_numbers(spark, tmp_path):
    numbers = [99998, 99999, 100000, 100001]
    for n in numbers:
        (tmp_path / f"part-{n}-ab12.json").write_text(f'{{"sql": "{n}"}}\n')
    rows = readers.read_predictions(spark, str(tmp_path)).orderBy("ord").collect()
    assert [int(r["sql"]) for r in rows] == numbers


def test_a_line_without_its_key_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"sql": "a"}\n{"text": "b"}\n')
    with pytest.raises(Exception, match="no sql at line 1"):
        readers.read_predictions(spark, str(tmp_path)).collect()


def test_stored_ord_must_be_unique(spark, tmp_path):
    line = json.loads(chat_line(0))
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"ord": o, **line}) for o in (3, 4, 3)))
    with pytest.raises(ValueError, match="stored ord 3"):
        readers.read_chat(spark, str(tmp_path), stored_ord=True)


@pytest.mark.parametrize("bad", ["{broken", "", "[1"])
def test_bad_line_fails(spark, tmp_path, bad):
    (tmp_path / "x.jsonl").write_text("\n".join([chat_line(0), bad, chat_line(2)]) + "\n")
    with pytest.raises(Exception, match="no JSON object at line 1|Malformed records"):
        readers.read_chat(spark, str(tmp_path)).collect()


def test_read_splits(spark, tmp_path):
    for name, n in (("train", 3), ("validation", 2)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(chat_line, range(n))))
    paths = {n: str(tmp_path / f"{n}.jsonl") for n in ("train", "validation")}
    got = readers.read_splits(spark, paths)
    assert sorted((r["split"], r["ord"]) for r in got.collect()) == [
        ("train", 0), ("train", 1), ("train", 2), ("validation", 0), ("validation", 1)]


@pytest.mark.parametrize("array", [True, False])
def test_questions_and_catalog(spark, tmp_path, array):
    def put(name, items):
        body = json.dumps(items, indent=1) if array else "\n".join(map(json.dumps, items))
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    questions = [{"db_id": "d", "query": f"SELECT {i}", "question": f"q{i}"} for i in range(5)]
    got = readers.read_questions(spark, put("q.json", questions), array).orderBy("ord").collect()
    assert [(r["ord"], r["query"]) for r in got] == [(i, f"SELECT {i}") for i in range(5)]

    def entry(db, table):
        return {"db_id": db, "table_names_original": [table],
                "column_names_original": [[-1, "*"], [0, "a"]], "foreign_keys": [[1, 1]]}

    catalog = [entry("d", "old"), entry("e", "x"), entry("d", "new")]
    rows = {r["db_id"]: r for r in readers.read_catalog(spark, put("c.json", catalog), array).collect()}
    assert rows["d"]["table_names_original"] == ["new"] and len(rows) == 2
    assert rows["e"]["column_names_original"] == [["-1", "*"], ["0", "a"]]
    assert rows["e"]["foreign_keys"] == [[1, 1]]


def test_write_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select(
        (999 - F.col("id")).alias("n"), (F.col("id") % 2).cast("string").alias("split"))
    write_jsonl(df.repartition(6), path, ["n"], ["split"], ["n"])
    for split in "01":
        numbers = []
        for part in sorted((tmp_path / "out" / f"split={split}").glob("part-*")):
            numbers += [json.loads(line)["n"] for line in part.read_text().splitlines()]
        assert numbers == [n for n in range(1000) if (999 - n) % 2 == int(split)]
    assert spark.read.json(path).count() == 1000


def test_summary_is_one_file(spark, tmp_path):
    write_summary(spark.range(50).repartition(5), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("part-*"))) == 1


def test_staged_tables(spark):
    rows = [(1, ""), (2, None), (3, "x")]
    staged = stage(spark.createDataFrame(rows, "id long, p string"))
    assert staged.columns == ["id", "p"]
    assert sorted(map(tuple, staged.collect())) == rows
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_purge_removes_the_folder(spark, monkeypatch, tmp_path):
    from corpusloom.sources import staging

    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path / "mine"))
    staging.stage(spark.range(3))
    assert (tmp_path / "mine").exists()
    purge(spark)
    assert not (tmp_path / "mine").exists()


def test_one_file_of_many_parts(spark, tmp_path):
    """The writer of the file does not sort, so its memory does not grow."""
    lines = spark.range(5000, numPartitions=7).select(
        F.col("id").alias("n"), F.when(F.col("id") == 9, "").otherwise(F.concat(F.lit('é "'), "id")).alias("value")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = stage(lines.orderBy(F.desc("n")).select("value"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(staged.inputFiles()) > 1
    write_lines(staged, str(tmp_path / "one"))
    files = list((tmp_path / "one").glob("part-*"))
    assert len(files) == 1
    assert files[0].read_text().split("\n") == ["" if i == 9 else f'é "{i}' for i in reversed(range(5000))] + [""]


def test_query_of_one_array_has_no_task_that_sorts_all(spark, monkeypatch):
    import __spark_entry__ as entry
    from corpusloom.registry import queries

    seen = []
    monkeypatch.setattr(queries, "write_lines", lambda staged, path: (seen.append(staged), write_lines(staged, path)))
    rows = entry.queries()["questions_one_array"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1
    values = [r["value"] for r in seen[0].collect()]
    assert rows.count() == len(values) - 2


def test_compressed_lines_are_read_alike(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.lit("SELECT "), "id").alias("sql"))
    write_jsonl(df.repartition(4), str(tmp_path / "z"), ["sql"], compression="gzip")
    assert all(str(f).endswith(".gz") for f in (tmp_path / "z").glob("part-*"))
    back = read_predictions(spark, str(tmp_path / "z")).orderBy("ord").collect()
    assert [r["sql"] for r in back] == sorted(f"SELECT {i}" for i in range(300)) and [r["ord"] for r in back] == list(range(300))
