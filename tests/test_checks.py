import pytest
from pyspark.sql import functions as F

from corpusloom.functions.features import padded, uses_window
from corpusloom.operators import checks

CHATS = [
    (0, [("system", "s"), ("user", "u"), ("assistant", "a")]),
    (1, [("system", "s"), ("assistant", "a"), ("user", "u")]),
    (2, [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "u")]),
]


@pytest.fixture
def chats(spark):
    return spark.createDataFrame(
        CHATS, "ord long, messages array<struct<role string, content string>>")


def test_check_roles(chats):
    assert [r["ord"] for r in checks.check_roles(chats).collect()] == [1, 2]


def test_require_roles(chats):
    assert checks.require_roles(chats.where("ord = 0")).count() == 1
    with pytest.raises(Exception, match="in record 1"):
        checks.require_roles(chats.where("ord < 2")).collect()


def test_role_report(spark):
    turns = [(c, i, role) for c, chat in CHATS for i, (role, _) in enumerate(chat)]
    turns += [(9, 0, "user")] * 3
    df = spark.createDataFrame(turns, "c long, t long, r string")
    got = {r["c"]: (r["n_turns"], r["ok"]) for r in checks.role_report(df, "c", "t", "r").collect()}
    assert got == {0: (3, True), 1: (3, False), 2: (4, False), 9: (3, False)}


def test_gate(spark, tmp_path):
    df = spark.createDataFrame([(0, True), (1, False), (2, None)], "ord long, ok boolean")
    checks.gate(df.where("ord = 0"), "ok")
    with pytest.raises(checks.GateError, match=r"2 rows rejected on ok; first: \[1, 2\]"):
        checks.gate(df, "ok", path=str(tmp_path / "rejects"))
    assert spark.read.json(str(tmp_path / "rejects")).count() == 2


def test_assert_none(spark):
    df = spark.createDataFrame([("SELECT a FROM t",)], "sql string")
    condition = uses_window(padded(F.col("sql")))
    checks.assert_none(df, condition, "window functions")
    more = df.union(spark.createDataFrame([("select rank() over (order by a)",)], "sql string"))
    with pytest.raises(checks.GateError, match="window functions"):
        checks.assert_none(more, condition, "window functions")


def test_over_cap(spark):
    df = spark.createDataFrame([("a" * 7,), ("a" * 10,), ("a" * 11,)], "t string")
    assert tuple(checks.over_cap(df, "t", 2).first()) == (3, 1)
