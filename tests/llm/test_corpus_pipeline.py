import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from corpusloom.llm import bpe
from odd_documents import TESTDATA, none, odd  # noqa: F401
from test_mixing import brute_targets, size
from test_pii import KINDS, PATTERNS, passes
from test_rule_cascade import metrics
from test_simhash import brute_fingerprint, brute_roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def redacted(text):
    """Base spans replaced, overlapping ones together."""
    spans = sorted(
        (m.start(), KINDS.index(kind), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if passes(kind, m[0])
    )
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"<{KINDS[kind].upper()}>"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def outputs(spark):
    """Every stage's rows, each from the rows before it."""
    sf_dir = str(TESTDATA / "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs.collect()]
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir).cache()
        found.append(docs.collect())
    return found


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "PII", "mixing", "byte-level BPE"]


def test_quality_rules(outputs):
    before, after = outputs[0], outputs[1]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if metrics(r["text"])[-1]}
    assert list(after[0].asDict()) == COLUMNS


def test_near_dedup(outputs):
    before, after = outputs[1], outputs[2]
    codes = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
    roots, least = brute_roots(set(codes.values())), {}
    for doc_id, code in sorted(codes.items()):
        least.setdefault(roots[code], doc_id)
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())
    assert list(after[0].asDict()) == COLUMNS


def test_personal_data(outputs):
    texts = {r["doc_id"]: r["text"] for r in outputs[2]}
    assert len(outputs[3]) == len(texts)
    for r in outputs[3]:
        assert r["text"] == redacted(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])


def test_personal_data_by_disclosure(spark):
    """The stage removes what gives an address away, also where the address is not."""
    rows = [(i, f"part{i} Zebulon me@x.org") for i in range(5)] + [(20, "so said Zebulon")]
    rows += [(100 + i, f"other text {i}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["PII"]
    after = {r["doc_id"]: r for r in stage(spark, docs, "").collect()}
    assert after[3]["text"] == "part3  <EMAIL>" and after[20]["text"] == "so said "
    assert after[20]["n_chars"] == 8 and after[107]["text"] == "other text 7"


def test_mixing(outputs):
    before, copies = outputs[3], Counter(r["doc_id"] for r in outputs[4])
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r["text"])
        taken[r["source"]] += size(r["text"]) * copies[r["doc_id"]]
    assert max(copies.values()) <= 3 and list(outputs[4][0].asDict()) == COLUMNS
    longest = max(size(r["text"]) for r in before)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= longest


def test_bpe(outputs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = outputs[4], outputs[5]
    assert Counter((r["doc_id"], r["text"]) for r in before) == Counter((r["doc_id"], r["text"]) for r in after)
    for r in after[:200]:
        assert r["ids"] == library.encode_ordinary(r["text"])


def test_run_equals_the_stages(spark, outputs):
    rows = corpus_pipeline.run(spark, str(TESTDATA / "sf0.01")).select("doc_id", "text").collect()
    assert Counter(map(tuple, rows)) == Counter((r["doc_id"], r["text"]) for r in outputs[5])


@pytest.mark.parametrize("number", range(5))
def test_every_stage_takes_odd_rows_and_no_rows(spark, odd, none, number):
    _, step = corpus_pipeline.STAGES[number]
    for docs in (odd, none):
        rows = step(spark, docs, "")
        assert rows.columns[: len(odd.columns)] == odd.columns
        assert rows.count() <= 3 * docs.count()
