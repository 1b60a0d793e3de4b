from corpusloom.functions.structure import statements, structure_ok

CASES = {
    "SELECT a FROM missing WHERE f(x) = 1": True,
    "SELECT a FROM t;;": True,
    " ( select 1 ) union select 2": True,
    "SELECT COUNT(*) FROM t WHERE `col name` = 1": True,
    "SELECT a FROM t WHERE x = 'it''s (' AND \"b'\" = '`'": True,
    "SELECT DISTINCT a FROM t": True,
    "WITH x AS (SELECT 1) SELECT * FROM x": True,
    "SELECT 'FROM' FROM t": True,
    "SELECT (a FROM t": False,
    "SELECT a) FROM (t": False,
    "SELECT FROM WHERE": False,
    "SELECT DISTINCT FROM t": False,
    "SELECT a FROM t WHERE b IN (SELECT FROM u)": False,
    "SELECT": False,
    "SELECT 'open": False,
    'SELECT "open': False,
    "SELECT `open": False,
    "SELECTED a FROM t": False,
    "": False,
    "Here it is": False,
    "FROM t": False,
    "SELECT a -- it's": True,
    "SELECT a -- it's\nFROM t WHERE b = 'x'": True,
    "SELECT a -- it's\n'": False,
    "/* ' ( */ SELECT a": True,
    "SELECT a /* open": False,
    "SELECT a /* * / **/ FROM t": True,
    "SELECT /* a */ FROM t": False,
    "SELECT a FROM t WHERE b = '-- /*' AND c = 1": True,
    "SELECT '/*' || a -- '": True,
    "SELECT [it's (] FROM [a\"b]": True,
    "SELECT [open FROM t": False,
    "SELECT a] FROM t": False,
    "-- nothing else": False,
    "SELECT a/**/FROM t": True,
    "SELECT /*" + "*" * 20_000 + "/ a": True,
    "SELECT a --" + "'(" * 20_000: True,
    "SELECT " + "(" * 5000 + "1" + ")" * 5000: True,
    "SELECT '" + "x''" * 20_000 + "'": True,
}


def test_structure(evaluate):
    assert dict(zip(CASES, evaluate(structure_ok, CASES))) == CASES


def test_null_is_not_sound(evaluate):
    assert evaluate(structure_ok, [None, "SELECT 1"]) == [False, True]


def test_statements(evaluate):
    texts = ["SELECT 1", "SELECT 1;;", "SELECT ';'; -- ;\nDROP TABLE t /* ; */;", "", " ; "]
    assert evaluate(statements, texts) == [1, 1, 2, 0, 0]
