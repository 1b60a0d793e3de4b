import hashlib
import os
import random
import struct
import subprocess
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import bpe
from corpusloom.llm.common import let
from odd_documents import TESTDATA, none, odd  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(library, text):
    ids = library.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def check(rows, frame, library):
    got = sorted([tuple(r) for r in frame.collect()], key=repr)
    assert got == sorted([(k, *brute(library, t)) for k, t in rows], key=repr)


def test_odd_documents(odd, ranks, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(rows, bpe.digests(odd, "doc_id", "text", ranks, PATTERN), library)


def test_query(spark, library):
    sf_dir = str(TESTDATA / "sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, entry.queries()["op2_bpe"](spark, sf_dir), library)


def test_strange_texts(spark, ranks, library):
    rng = random.Random(2)
    letters = [chr(c) for c in [*range(1, 700), 0x3000, 0x4E2D, 0x1F600, 0xA0, 0x85, 0x2028, 0x2003, 0x0301]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += ["  a   b\n\n c \t", "don't I'LL we're 's ' s", "1234567 12,5", " ", "\n \n", "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    check(list(enumerate(texts)), bpe.digests(docs, "doc_id", "text", ranks, PATTERN), library)


def test_fold_equals_the_library(spark, ranks, library):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    words += ["".join(chr(rng.randint(0x80, 0x7FF)) for _ in range(9)) for _ in range(50)] + ["a" * 64, "zz" * 20]
    frame = spark.createDataFrame(list(enumerate(words)), "i int, word string")
    coded = frame.select("i", "word", bpe.rank_table(spark, ranks).select("buckets").scalar().alias("b"))
    for r in coded.select("i", let(F.col("b"), lambda b: bpe.fold(F.col("word"), b)).alias("ids")).collect():
        assert r["ids"] == library._encode_single_piece(words[r["i"]])


def test_merge_equals_the_library(ranks, library):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 2, 65, 66, 100, 400, 20_000)]
    words += ["a" * n for n in (65, 127, 50_000)] + ["ab" * 500, "日本語" * 60, "zz" * 33 + "the" * 40]
    for word in words:
        assert bpe.merge(word.encode(), ranks) == library._encode_single_piece(word)


def test_head_is_bounded_and_whole(spark, ranks, library):
    docs = spark.createDataFrame([("the cat the dog the cat a",), ("the " * 5 + "x" * 100 + " " + "x" * 100,)], "text string")
    known = {r["word"]: r["ids"] for r in bpe.head(docs, "text", PATTERN, ranks, words=2).collect()}
    assert set(known) == {" the"}
    known = {r["word"]: r["ids"] for r in bpe.head(docs, "text", PATTERN, ranks).collect()}
    assert known == {w: library._encode_single_piece(w) for w in ("the", " the", " cat")}


def test_memo_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    coder = bpe.Coder({}, ranks, PATTERN)
    for i in range(50):
        text = f"word{i} qwrtp{i}xz again"
        assert coder.encode(text) == struct.pack(f"<{len(ids := library.encode_ordinary(text))}I", *ids)
        assert len(coder) <= 3 and coder.decode(coder.encode(text)) == text.encode()


def test_empty_table(none, ranks):
    assert bpe.digests(none, "doc_id", "text", ranks, PATTERN).count() == 0


def test_round_trip(odd, ranks, library):
    rows = bpe.round_trip(odd, "text", ranks, PATTERN)
    assert rows.columns == [*odd.columns, "ids"]
    texts = {r["key"]: r["text"] or "" for r in odd.collect()}
    for r in rows.collect():
        assert r["text"] == texts[r["key"]]
        assert r["ids"] == library.encode_ordinary(texts[r["key"]])


def test_workers_stay_small(spark, odd, ranks):
    """Encoding imports no pandas, which takes more memory than the dictionary."""
    probe = "import sys; from corpusloom.llm import bpe; import pyarrow as pa; " + (
        "a = bpe._strings([b'x', b'', 'é'.encode()]).to_pylist(); b = bpe._lists([b'\\1\\0\\0\\0' * 2, b'']).to_pylist(); "
        "assert a == ['x', '', 'é'] and b == [[1, 1], []] and bpe._strings([]).to_pylist() == []; "
        "assert 'pandas' not in sys.modules"
    )
    root = os.path.dirname(entry.__file__)
    subprocess.run([sys.executable, "-c", probe], check=True, cwd=root)
    coder = bpe.Coder({}, ranks, PATTERN)
    sizes = []
    for i in range(60):
        coder.encode(" ".join(f"q{i}x{j}" for j in range(1000)))
        sizes.append(len(coder))
    assert max(sizes) <= 40_000


def test_ranks_reach_the_plan_without_python(spark, ranks):
    table = bpe.rank_table(spark, ranks)
    assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
    assert sum(map(len, table.first()["buckets"])) == len(ranks)
