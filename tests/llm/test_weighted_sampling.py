import hashlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from corpusloom.llm import weighted_sampling as ws
from odd_documents import TESTDATA, none, odd  # noqa: F401


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    if not a or not b:
        return float(bool(a) == bool(b))
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows):
    """Rows in order with the edited text and the successor's text."""
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        yield key, text, text[: len(text) - half] + after[:half], after


def check(rows, frame):
    got = {}
    for r in frame.collect():
        got.setdefault((r[0], r["n_chars"], r["edited_sha256"]), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    errors = []
    for key, text, edited, after in brute(rows):
        r = got[key, len(text), hashlib.sha256(edited.encode()).hexdigest()][0]
        errors.append(r["near_edited"] - jaccard(text, edited))
        errors.append(r["near_next"] - jaccard(text, after))
    errors = np.array(errors)
    assert np.abs(errors).max() < 0.25 and np.sqrt((errors**2).mean()) < 0.05


def test_query(spark):
    sf_dir = str(TESTDATA / "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs), reverse=True)
    check(rows, entry.queries()["op9_weighted_sampling"](spark, sf_dir))


def test_successors_of_odd_rows(odd):
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in plain.collect()), reverse=True)
    check(rows, ws.edits(plain.select("text", "doc_id", "key")))
    assert ws.edits(odd).count() == odd.count()


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ws, "ROWS_PER_PART", 3)
    rows = [(i * 7 - 100, f"word{i} and some other words {i % 5} " * 3) for i in range(200)]
    check(sorted(rows, reverse=True), ws.edits(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)))


def test_bounds_are_found_by_bisection(spark, monkeypatch):
    rows = [(i * 3, f"text number {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(map(tuple, ws.edits(df).collect()))
    monkeypatch.setattr(ws, "ROWS_PER_PART", 1)
    fine = ws.edits(df)
    assert "array_contains" not in fine._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, fine.collect())) == whole


def test_one_row_follows_itself(spark):
    r = ws.edits(spark.createDataFrame([(3, "abcdef")], "doc_id bigint, text string")).collect()
    assert len(r) == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r[0]["near_next"] == 1


def test_equal_texts_have_equal_fingerprints(odd):
    by_text = {}
    for r in odd.select("key", "text").join(ws.fingerprints(odd, "key", "text"), "key").collect():
        assert by_text.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    assert by_text[""] == "0" * 4 * ws.SAMPLES


def test_collisions_estimate_the_generalised_jaccard_similarity():
    sampler, rng = ws.Sampler(), np.random.default_rng(1)
    errors = []
    for _ in range(150):
        terms = [f"t{i}" for i in rng.choice(10_000, 40, replace=False)]
        a = {t: float(rng.integers(1, 9)) for t in terms[:30]}
        b = {t: a.get(t, 1.0) * rng.choice([1, 1, 2]) for t in terms[rng.integers(0, 25) :]}
        low = sum(min(a[t], b[t]) for t in a.keys() & b.keys())
        true = low / (sum(a.values()) + sum(b.values()) - low)
        errors.append((sampler.of_weights(a) == sampler.of_weights(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_empty_table(none):
    assert ws.edits(none).count() == 0
