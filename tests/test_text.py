import random

import models
from corpusloom.functions import text as tx

FIELDS = ["SELECT", "a", "(", ")", ",", "=", "<", ">", "'", "''", " ", "  ", "\t", "\n", ";",
          "\xa0", " ", "\x1c", "`c d`", "it", "Straße", "é"]


def random_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(FIELDS, k=rng.randint(0, 25))) for _ in range(n)]


def test_strip_removes_what_python_removes(evaluate):
    texts = [f"{chr(c)}a b{chr(c)}" for c in range(1, 0x3100) if chr(c).isspace()]
    assert evaluate(tx.strip, texts) == [t.strip() for t in texts]
    assert evaluate(tx.strip, ["​a​"]) == ["​a​"]


def test_one_blank_covers_every_white_space_character(evaluate):
    texts = [f"a{chr(c)}{chr(c)}b" for c in range(1, 0x3100) if chr(c).isspace()]
    assert set(evaluate(tx.one_blank, texts)) == {"a b"}
    others = [f"a{chr(c)}{chr(c)}b" for c in range(0x21, 0x3100) if not chr(c).isspace()]
    assert evaluate(tx.one_blank, others) == others


def test_clean_target(evaluate):
    texts = [" SELECT 1 ;; ", "SELECT 1", "a; ;", ";", "", "x;\n"]
    assert evaluate(tx.clean_target, texts) == ["SELECT 1", "SELECT 1", "a;", "", "", "x"]
    assert evaluate(tx.had_semicolon, texts) == [True, False, True, True, False, True]


def test_collapse_sql_literals(evaluate):
    cases = {
        "a  b 'x  y' ; ": "a b 'x  y'",
        "it''s": "it''s",
        "'  k '' z  '  ;": "'  k '' z  '",
        " x ; ;": "x ;",
        "a '": "a '",
        "a  'b  ": "a 'b",
    }
    assert evaluate(tx.collapse_sql, cases) == list(cases.values())


def test_collapse_sql_equals_model(evaluate):
    texts = random_texts(1)
    assert evaluate(tx.collapse_sql, texts) == [models.collapse(t) for t in texts]


def test_norm_sql(evaluate):
    assert evaluate(tx.norm_sql, ["SELECT (  a ),b  FROM t;;"]) == ["SELECT(A),B FROM T"]
    texts = random_texts(2)
    assert evaluate(tx.norm_sql, texts) == [models.norm(t) for t in texts]


def test_mask_backticks(evaluate):
    assert evaluate(tx.mask_backticks, ["`a b`.`c` = `", "``"]) == ["x.x = `", "x"]


def test_db_of(evaluate):
    prompts = ["Database: shop \n\nSchema:", "Database:Database: x", "no header"]
    assert evaluate(tx.db_of, prompts) == ["shop", "x", "no header"]


def test_unfence(evaluate):
    cases = {
        "SELECT 1": "SELECT 1",
        "  SELECT 1\n": "SELECT 1",
        "Here: ```sql\nSELECT 1\n``` done": "SELECT 1",
        "```\nSELECT 1\n```": "SELECT 1",
        "a```b": "a",
        "```sql\nSELECT sql FROM t\n```": "SELECT sql FROM t",
        "```a``` then ```sql b```": "b",
    }
    assert evaluate(tx.unfence, cases) == list(cases.values())


def test_question_tail(evaluate):
    long = "Question:\n" + "q" * 200 + "\n\nReturn only SQL."
    got = evaluate(tx.question_tail, ["Question: a Question:\n b ", long, "none"])
    assert got == ["b", "q" * 119, "none"]


def test_est_tokens_counts_characters(evaluate):
    texts = ["", "abc", "abcd", "é" * 7, "😀" * 35]
    assert evaluate(tx.est_tokens, texts) == [int(len(t) / 3.5) for t in texts]
