import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import toxicity
from corpusloom.llm.common import held_out
from odd_documents import TESTDATA, none, odd  # noqa: F401

WORDS = ["moron", "idiot", "pathetic", "worthless", "scum"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(WORDS), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("abdimorstu0"), st.booleans()), max_size=2))
def test_automaton_equals_edit_distance(word, changes):
    for at, letter, insert in changes:
        at = min(at, len(word))
        word = word[:at] + letter + word[at + (not insert) :]
    lexicon = toxicity.Lexicon(WORDS, [])
    near = min((distance(word, w), w) for w in WORDS)
    if near[0] == 0:
        expected = (near[1], 0)
    else:
        close = [(distance(word, w), w) for w in WORDS if len(w) >= 5 and distance(word, w) <= 1]
        expected = (min(close)[1], 1) if close else None
    assert lexicon.find(word) == expected


def test_beginnings_stand_for_families():
    lexicon = toxicity.Lexicon(["moron"], ["lowei"])
    assert lexicon.find("loweischaft") == ("lowei*", 0)
    assert lexicon.find("loweix") == ("lowei*", 0)
    assert lexicon.find("lowe") is None


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["lowei", "gammelk"]), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("aegiklmow0"), st.booleans()), max_size=2), st.text("aekx", max_size=4))
def test_misspelt_families_equal_edit_distance(family, changes, rest):
    word = family + rest
    for at, letter, insert in changes:
        at = min(at, len(word))
        word = word[:at] + letter + word[at + (not insert) :]
    families = ["gammelk", "lowei", "scum"]
    expected = next(((p + "*", 0) for p in families if word.startswith(p)), None)
    if expected is None:
        longer = [p for p in families if 5 <= len(p) < len(word)]
        close = [(min(distance(word[:i], p) for i in range(len(word) + 1)), p + "*") for p in longer]
        expected = min(((p, d) for d, p in close if d <= 1), key=lambda c: c[::-1], default=None)
    assert toxicity.Lexicon([], families).find(word) == expected


def test_no_term_is_cut_by_number():
    counted = [(f"term{i:04d}", 50) for i in range(2000)]
    assert len(toxicity.choose_terms(counted)[0]) == 2000


def test_choice_of_terms():
    counted = [("idio*", 100), ("idiot", 98), ("lowei*", 80), ("loweia", 30), ("loweib*", 20), ("scum", 40)]
    assert toxicity.choose_terms(counted) == (["idiot", "scum"], ["lowei"])


def test_quotation_weighs_less_than_abuse():
    lexicon = toxicity.Lexicon(WORDS, [])
    place = toxicity.FEATURES.index("abuse")
    quoted = toxicity.vector('he said the word "moron" was in the script', lexicon)
    abuse = toxicity.vector("you are a moron and an idiot!", lexicon)
    assert quoted[place] == 0 and quoted[toxicity.FEATURES.index("quoted")] == 1
    assert abuse[place] > 1


def test_held_out_accuracy_of_the_query(spark):
    sf_dir = str(TESTDATA / "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = entry.queries()["op8_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for y, p in held if y]) > 0.8
    assert np.mean([p for y, p in held if not y]) < 0.01


def training_set(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("the of and to in was that house garden".split()) for _ in range(40)]
        if i % 5 == 0:
            words[rng.randint(0, 39)] = rng.choice(WORDS)
            words[rng.randint(0, 39)] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_misspelled_terms_are_caught(spark):
    docs, labels = training_set(spark)
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic", F.lit(True))
    assert set(model.lexicon[0]) == set(WORDS) and not model.lexicon[1]
    texts = ["you m0ron, you are w0rthless and pathetlc", "the house and the garden", "you moron, worthless scum"]
    new = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.scored(new, "doc_id", "text", model).collect()}
    assert found == {0: 1, 1: 0, 2: 1}


def test_held_out_labels_are_not_used(spark):
    docs, labels = training_set(spark)
    held = held_out(F.col("doc_id"), 5, 0)
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train(docs, x, "doc_id", "text", "toxic", ~held) for x in (labels, flipped))
    assert one == two


def test_odd_rows_and_missing_labels(spark, odd, none):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 1)], "doc_id bigint, toxic int")
    assert toxicity.train(odd, labels, "doc_id", "text", "toxic", F.lit(True)) is None
    docs, known = training_set(spark)
    model = toxicity.train(docs, known, "doc_id", "text", "toxic", F.lit(True))
    rows = toxicity.scored(odd, "doc_id", "text", model).collect()
    assert len(rows) == odd.count() and not any(r["predicted"] for r in rows)
    assert {r["score"] for r in toxicity.scored(odd, "doc_id", "text", None).collect()} == {0.0}
    assert toxicity.scored(none, "doc_id", "text", model).count() == 0
