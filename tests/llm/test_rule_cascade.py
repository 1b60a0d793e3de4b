import re
from collections import Counter

import __spark_entry__ as entry
from corpusloom.llm import rule_cascade
from odd_documents import TESTDATA, none, odd  # noqa: F401


def metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 50 or 100 * len(inside) > 50 * n
    chars = sum(map(len, words))
    again = len(lines) - len(set(lines))
    bad = failed or 10 * symbols > 3 * n or chars > 30 * n or chars < 2 * n or 2 * again > len(lines)
    return (n, chars, symbols, again, len(inside), failed, not bad)


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_report_equals_brute_force(odd):
    expected = sorted([(r["doc_id"], *metrics(r["text"])) for r in odd.collect()], key=repr)
    assert as_rows(rule_cascade.report(odd, "doc_id")) == expected


def test_query_equals_brute_force(spark):
    sf_dir = str(TESTDATA / "sf0.001")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = sorted([(r["doc_id"], *metrics(r["text"])) for r in docs], key=repr)
    assert as_rows(entry.queries()["op10_rule_cascade"](spark, sf_dir)) == expected


def test_keep_returns_the_passing_rows(odd):
    expected = sorted([tuple(r) for r in odd.collect() if metrics(r["text"])[-1]], key=repr)
    kept = rule_cascade.keep(odd)
    assert kept.columns == odd.columns
    assert as_rows(kept) == expected


def test_order_does_not_change_the_verdict(odd):
    get = rule_cascade._from_text(odd["text"])
    names = [r.name for r in rule_cascade.RULES]
    verdicts = [
        [r[0] is None for r in odd.select(rule_cascade.rejected_by(order, rule_cascade.RULES, get)).collect()]
        for order in (names, names[::-1])
    ]
    assert verdicts[0] == verdicts[1]


def test_pages_of_repeated_lines_go(spark):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    lines = {1: [own(1), *["short line"] * 3, own(2)], 2: [own(3), own(4)], 3: [own(5), "a", "a"], 4: [own(6), *["b"] * 4]}
    docs = spark.createDataFrame([(k, "\n".join(v)) for k, v in lines.items()], "doc_id int, text string")
    assert {r["doc_id"]: r["kept"] for r in rule_cascade.report(docs, "doc_id").collect()} == {1: True, 2: True, 3: True, 4: False}


def test_order_is_the_same_every_time(spark):
    """Rules of clearly different worth."""
    docs = spark.read.parquet(str(TESTDATA / "sf0.01" / "documents.parquet"))
    sample = rule_cascade.sample_of(docs, "text")
    orders = {tuple(rule_cascade.plan(sample, "text")[:2]) for _ in range(4)}
    assert len(orders) == 1 and next(iter(orders))[0] == "few_words"


def test_plan_names_every_rule_once(odd):
    order = rule_cascade.plan(rule_cascade.sample_of(odd, "text"), "text")
    assert sorted(order) == sorted(r.name for r in rule_cascade.RULES)


def test_empty_table(none):
    assert rule_cascade.report(none, "doc_id").count() == 0
    assert rule_cascade.keep(none).columns == none.columns
