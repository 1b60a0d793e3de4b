import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

import __spark_entry__ as entry
from corpusloom.llm import token_frames as tf
from odd_documents import TESTDATA, none, odd  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def brute(library, rows):
    start, out = 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def as_rows(frame):
    return sorted([tuple(r) for r in frame.collect()], key=lambda r: (r[1], r))


def test_query(spark, library):
    sf_dir = str(TESTDATA / "sf0.001")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    expected = brute(library, [(r["doc_id"], r["text"]) for r in docs])
    assert as_rows(entry.queries()["op3_token_frames"](spark, sf_dir)) == expected


def test_odd_documents(odd, library):
    plain = odd.dropDuplicates(["doc_id"]).cache()
    rows = sorted(((r["doc_id"], r["text"]) for r in plain.collect()), key=lambda r: (r[0] is not None, r[0]))
    assert as_rows(tf.write_and_read(plain, PATH, [1])) == brute(library, rows)
    assert tf.write_and_read(odd, PATH, [1]).count() == odd.count()


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcİΣσςÀèÑßŁœ .,'s1２日é́\n\t\r\x1c\x85　\xa0-!🙂<|>"), max_size=40))
def test_pieces_equal_the_whole(text):
    encoder = tf.encoder_of(PATH)
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == whole


def test_special_tokens_are_text(library):
    ids = np.frombuffer(tf.Encoder(PATH).ids("x <|endoftext|> y"), "<u2").tolist()
    assert ids == library.encode("x <|endoftext|> y", add_special_tokens=False).ids and 49407 not in ids


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.fetched = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        data = super().read(n)
        self.fetched += len(data)
        return data


def a_file(n=500):
    rng = random.Random(1)
    rows = [(i if i % 50 else None, np.array(rng.choices(range(40_000), k=rng.randint(0, 900)), "<u2")) for i in range(n)]
    sink = pa.BufferOutputStream()
    assert tf.write_file(sink, ((k, v.tobytes()) for k, v in rows), 2) == (n, sum(len(v) for _, v in rows))
    return rows, sink.getvalue().to_pybytes()


def test_reader_fetches_only_what_is_asked_for():
    rows, data = a_file()
    source = Counting(data)
    reader = tf.Reader(source)
    tail = source.fetched
    assert tail < len(data) / 20
    assert reader.find(77) == [77] and reader.key(50) is None
    assert reader.ids(77).tolist() == rows[77][1].tolist()
    assert source.fetched - tail == reader.frames["packed"][77]
    for i, (_, ids) in enumerate(rows):
        assert reader.ids(i).tolist() == ids.tolist()


def test_frames_are_plain_zstandard():
    rows, data = a_file(20)
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(ids.tobytes() for _, ids in rows)


def test_damage_is_noticed():
    rows, data = a_file(50)
    reader = tf.Reader(Counting(data))
    at = int(reader.starts[7]) + int(reader.frames["packed"][7]) // 2
    damaged = tf.Reader(Counting(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]))
    assert damaged.ids(8).tolist() == rows[8][1].tolist()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.ids(7)


def test_requested_documents_from_the_manifest(spark, odd, library):
    folder = tf.new_folder(odd)
    manifest = tf.write(odd.where("doc_id < 60"), folder, PATH, [1]).collect()
    store, place = fs.FileSystem.from_uri(folder)
    found = {}
    for r in manifest:
        with store.open_input_file(f"{place}/{r['file']}") as source:
            reader = tf.Reader(source)
            found |= {12: reader.ids(i).tolist() for i in reader.find(12)}
    text = odd.where("doc_id = 12").first()["text"]
    assert found[12] == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_empty_table(none):
    assert tf.write_and_read(none, PATH, [1]).count() == 0
