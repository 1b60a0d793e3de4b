import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import pii
from odd_documents import TESTDATA, none, odd  # noqa: F401

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    spans = sorted(
        (m.start(), KINDS.index(kind), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    )
    written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    counts = [sum(s[1] == k for s in spans) for k in range(4)]
    return (*counts, hashlib.sha256(written.encode()).hexdigest()), written


TEXTS = [
    "a@b.c_x@d.e mail me@x.org. or @x.org x@y a@b..c me@x.org,you@x.org",
    "1.2.3.4.5.6.7.8 256.1.1.1 255.255.255.255 001.02.3.4 1.2.3 0256.1.1.1 .1.2.3.4. 1..2.3.4",
    "4539 1488 0343 6467 and 4539-1488-0343-6467 and 4539148803436467 1 2 3 4",
    "9807915762804490 98079157628044901 12--34 4539 1488 0343 6467 0",
    "+49 (30) 1234567 +1 2 +123456789012345678 ++4912345678901 +4912345678901+4912345678902",
    "日本 🙂 me@x.org 🙂 +49 30 1234567 é 1.1.1.1",
    "x" * 30_000 + "@" + "1" * 30_000 + " 1" * 20_000,
    "%%%@-.-.- a+b@c-d.e-f 1.1.1.1@x.y 4539148803436467@x.y",
    "", None,
]


def test_base_spans_equal_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    for i, text in enumerate(TEXTS):
        expected, written = brute(text)
        assert tuple(got[i])[1:6] == expected
        assert got[i]["spans"] == written


def test_query_has_the_base_spans(spark):
    sf_dir = str(TESTDATA / "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.queries()["op5_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected, written = brute(texts[r["doc_id"]])
        assert tuple(r)[1:6] == expected
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


@pytest.fixture(scope="module")
def secrets(spark):
    """One address in four contexts next to a word of its own and a common one."""
    rows = [(i, f"note {i} alpha{i} boss@corp.org Zebulon knows beta{i} the rest") for i in range(4)]
    rows += [(10 + i, f"the common text number {i} knows nothing at rest") for i in range(60)]
    rows += [(80, "copy kwx me@x.org same"), (81, "copy kwx me@x.org same"), (82, "copy kwx me@x.org same")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_disclosing_terms(secrets):
    held = pii.found(secrets, "doc_id", "text")
    told = {(r["entity"], r["term"]): r["share"] for r in pii.disclosures(secrets, "text", held).collect()}
    # n = df = 4 of 67: PMI = IC; "knows" and "the" are common, copies are one context
    assert told[("email:boss@corp.org", "zebulon")] == pytest.approx(1.0)
    assert {t for _, t in told} <= {"zebulon", "note"}


def test_copies_count_once_on_every_side(spark):
    """Three texts in a thousand copies each."""
    rows = [(1000 * c + i, f"part{c} Zebulon me@x.org") for c in range(3) for i in range(1000)]
    rows += [(10_000 + i, f"other text {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = pii.found(docs, "doc_id", "text")
    told = {r["term"]: r["share"] for r in pii.disclosures(docs, "text", held).collect()}
    assert told == {"zebulon": pytest.approx(1.0)}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == clean[999] == "part0  <EMAIL>" and clean[10_007] == "other text 7"


def test_terms_far_from_the_entity(spark):
    far = "und so weiter " * 30
    rows = [(i, f"Zebulon {far} part{i} me@x.org 日本語me@x.org") for i in range(3)]
    rows += [(10 + i, f"und so weiter other text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == f" {far} part0 <EMAIL> <EMAIL>"
    assert clean[17] == "und so weiter other text 7"


def test_terms_without_the_entity(spark):
    rows = [(i, f"part{i} Zebulon me@x.org") for i in range(9)]
    rows += [(50, "so said Zebulon"), (51, "write to zebulon@y.org")]
    rows += [(100 + i, f"other text {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[50] == "so said " and clean[51] == "write to <EMAIL>" and clean[0] == "part0  <EMAIL>"
    assert {r["spans"] for r in pii.scan(docs).where("doc_id = 50").collect()} == {"remove:8:15"}


def test_sanitised_text(secrets):
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(secrets).collect()}
    assert clean[0] == " 0 alpha0 <EMAIL>  knows beta0 the rest"
    assert clean[80] == "copy kwx <EMAIL> same"
    assert clean[10] == "the common text number 0 knows nothing at rest"


def test_overlapping_spans_are_replaced_together(spark):
    docs = spark.createDataFrame([(1, "x 1.1.1.1@x.y z +4539148803436467 q", 3)], "doc_id int, text string, n_chars int")
    r = pii.sanitised(docs, n_chars="n_chars").first()
    assert r["text"] == "x <EMAIL> z <CARD> q" or r["text"].startswith("x <EMAIL> z ")
    assert r["n_chars"] == len(r["text"])


def entities_of(kind, value):
    digits, low = re.sub("[^0-9]", "", value), value.lower()
    if kind == "email":
        return {f"email:{low}", "domain:" + low.split("@")[1]}
    if kind == "ip":
        return {f"ip:{value}", "network:" + ".".join(value.split(".")[:3])}
    return {f"card:{digits}", f"issuer:{digits[:6]}"} if kind == "card" else {f"phone:{digits}", f"block:{digits[:-4]}"}


def brute_disclosures(texts):
    """All (entity, term) to share, by counting different texts."""
    held = []
    for text in {t or "" for t in texts}:
        entities, masked = set(), list(text)
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, text):
                if passes(kind, m[0]):
                    entities |= entities_of(kind, m[0])
                    masked[m.start() : m.end()] = " " * (m.end() - m.start())
        held.append((entities, set(regex.findall(r"[\p{L}\p{N}]{3,}", "".join(masked).lower()))))
    n = len(held)
    df = Counter(t for _, terms in held for t in terms)
    df_entity = Counter(e for entities, _ in held for e in entities)
    both = Counter((e, t) for entities, terms in held for e in entities for t in terms)
    told = {}
    for (e, t), together in both.items():
        value = e.split(":")[0] in KINDS
        least = pii.SUPPORT if value else pii.GROUP_SUPPORT
        if together < least or df_entity[e] == n:
            continue
        share = math.log2(n * together / (df_entity[e] * df[t])) / -math.log2(df_entity[e] / n)
        if share >= pii.GENERALISE:
            told[e, t] = share
    return told


def found_disclosures(docs):
    rows = pii.disclosures(docs, "text", pii.found(docs, "doc_id", "text")).collect()
    return {(r["entity"], r["term"]): r["share"] for r in rows}


@pytest.mark.parametrize("seed, block", [(1, 64), (3, 2)])
def test_disclosures_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pii, "ENTITIES", block)
    rng = random.Random(seed)
    people = [(f"p{i}@site{i % 3}.org", f"name{i}", f"+49 30 12345{i:02d}") for i in range(12)]
    cards = ["4539148803436467", "4916338506082832"]
    texts = []
    for i in range(260):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 12))]
        for person in rng.sample(people, rng.choice([0, 0, 1, 1, 2, 6])):
            words += rng.sample(person, rng.randint(1, 3))
        words += [rng.choice(cards)] * (rng.random() < 0.1) + [f"10.0.{rng.randint(0, 2)}.7"] * (rng.random() < 0.1)
        rng.shuffle(words)
        texts += [" ".join(words)] * rng.choice([1, 1, 1, 4])
    texts += [None, "", "İstanbul p1@site1.org", "İSTANBUL p1@site1.org x", "İstanbul p1@site1.org y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    expected = {k: v for k, v in brute_disclosures([t and t.replace("İ", "i") for t in texts]).items()}
    got = found_disclosures(docs)
    assert set(got) == set(expected) and len(got) > 3
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    assert any(e.startswith("domain:") for e, _ in got) or seed != 1


def test_disclosures_of_the_documents(spark):
    """Their personal data does not recur: what brute force finds, nothing mostly."""
    docs = spark.read.parquet(str(TESTDATA / "sf0.01" / "documents.parquet"))
    expected = brute_disclosures([r["text"] for r in docs.collect()])
    got = found_disclosures(docs)
    assert {k: pytest.approx(v) for k, v in expected.items()} == got


@pytest.mark.parametrize("unit", ["me{}@x.org ", "word{} "])
def test_cost_grows_with_the_length(spark, unit):
    def seconds(column, n):
        text = "".join(unit.format(i) for i in range(n))
        rows = spark.createDataFrame([(i, text) for i in range(4)], "doc_id int, text string").coalesce(1)
        job = rows.select(F.sum(F.length(column)))
        times = []
        for _ in range(4):
            start = time.perf_counter()
            job.collect()
            times.append(time.perf_counter() - start)
        return min(times)

    base = pii.base_spans(F.col("text"))
    terms = pii._located(pii._term_text(F.col("text"), base), pii.TERM, 4, "generalise")
    for column in (pii.redacted(F.col("text"), base), F.to_json(terms)):
        assert seconds(column, 16_000) <= 2.5 * seconds(column, 8_000)


def test_long_texts_equal_python(spark):
    rng = random.Random(9)
    units = ["me{}@x.org", "1{}.2.3.4", "4539148803436467", "+49 30 12345{:04d}", "wort{}", "é🙂{}", "12 34 5"]
    text = " ".join(rng.choice(units).format(rng.randint(0, 99)) for _ in range(9_000))
    docs = spark.createDataFrame([(1, text), (2, text[:4096]), (3, text[:4097]), (4, text[5:8197])], "doc_id int, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    for r in pii.scan(docs).collect():
        given = {1: text, 2: text[:4096], 3: text[:4097], 4: text[5:8197]}[r["doc_id"]]
        expected, written = brute(given)
        assert tuple(r)[1:6] == expected and r["spans"] == written
        out, at = "", 0
        for span in filter(None, written.split(",")):
            kind, start, end = span.split(":")
            if int(start) >= at:
                out += given[at : int(start)] + f"<{kind.upper()}>"
            at = max(at, int(end))
        assert clean[r["doc_id"]] == out + given[at:]


def test_terms_by_the_words_of_the_text(spark):
    """Only whole words go, whatever their case; digits and letters bound them."""
    rows = [(i, f"Zebulon9 ÉLAN part{i} me@x.org") for i in range(4)]
    rows += [(10, "zebulon9s zebulon9 ZEBULON9, xzebulon9 _Zebulon9_ élan"), (11, "İ zebulon9")]
    rows += [(100 + i, f"other text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    # the one word stands in two more texts, so it is generalised; the other in one, so it goes
    assert clean[10] == "zebulon9s <WORD> <NAME>, xzebulon9 _<NAME>_ " and clean[11] == "İ <WORD>"


def test_a_directory_of_many_entities(spark):
    """Every entity of a long list meets the list's terms, dealt to blocks."""
    people = " ".join(f"p{i}@x{i}.org" for i in range(500))
    rows = [(k, f"{people} Directory version{k}") for k in range(3)] + [(10 + i, f"other text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    held = pii.found(docs, "doc_id", "text")
    pairs = pii.candidates(held, 203).collect()
    assert {r["term"] for r in pairs} == {"directory"} and len({r["entity"] for r in pairs}) == 500
    assert pii.sanitised(docs).where("doc_id = 1").first()["text"] == " ".join(["<EMAIL>"] * 500) + "  version1"


def test_odd_rows_stay(odd):
    clean = pii.sanitised(odd)
    assert clean.columns == odd.columns
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, odd.collect()))
    assert pii.scan(odd).count() == odd.count()


def test_empty_table(none):
    assert pii.scan(none).count() == 0
    assert pii.sanitised(none).count() == 0
