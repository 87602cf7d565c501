"""op13 against the sentencepiece library, and its parts against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docledger.llm import piece_codec
from docledger.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def numbers(blob):
    return np.frombuffer(blob, "<u4").tolist()


PARTS = ["a", "the", "ing", " ", "  ", "▁", "\n", "\t", "\x00", "é", "日本", "😀", "ﷺ", "ก", "<s>", "<0x0A>", "'", "10", "==", "--", "...", "ии", "strawberry", "onon"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4).filter(lambda t: t.isprintable() or not t), max_size=30))
def test_ids_and_texts_are_the_librarys(library, parts):
    text, c = "".join(parts), piece_codec.codec(PATH)
    want = library.encode(text, add_bos=True, add_eos=True)
    assert numbers(c.encode([text], True, True)[0]) == want
    assert c.decode(np.array(want, "<u4").tobytes()) == library.decode(want)


@pytest.mark.parametrize("unit", [" ", "a", "=", "-", "▁", "é", "ab", "the", "\n", " a", "  b"])
def test_long_repeats(library, unit):
    text = unit * 3001
    assert numbers(piece_codec.codec(PATH).encode([text])[0]) == library.encode(text)


def test_any_ids_decode_as_the_library_does(library):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert piece_codec.codec(PATH).decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_compatible_pairs_are_those_that_merge_to_themselves():
    c, rng = piece_codec.codec(PATH), random.Random(4)
    names = [p for p in c.first if p.isascii() or piece_codec.MARK in p]
    seen = 0
    for _ in range(20_000):
        a, b = rng.choice(names), rng.choice(names)
        assert c.compatible(a, b) == (piece_codec.merges(a + b, c.scores)[0] == [a, b])
        seen += not c.compatible(a, b)
    assert seen > 50


def test_caches_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_ROWS", 3)
    monkeypatch.setattr(piece_codec, "CACHE_PAIRS", 3)
    c = piece_codec.PieceCodec(PATH)
    for text in ("one two three four five", "two six  seven", "five one\neight"):
        assert numbers(c.encode([text])[0]) == library.encode(text)


def test_query_is_the_librarys(spark, library):
    want = {}
    for r in spark.read.parquet(f"{WHERE}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        digest = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        want[r["doc_id"]] = (len(ids), *digest)
    rows = QUERIES["op13_sentencepiece"](spark, WHERE).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want
    assert len(rows) == len(want)


def test_null_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "x", 7), (2, "x", 7)], "doc_id long, text string, ids int")
    coded = piece_codec.encode(docs, PATH)
    rows = piece_codec.decode(coded.unionByName(coded.selectExpr("doc_id", "cast(null as binary) ids").where("doc_id = 1")), PATH).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), len(r["ids"] or b"")) for r in rows) == [("1", "", 8), ("1", "None", 0), ("2", "x", 12), ("2", "x", 12), ("None", "", 8)]
