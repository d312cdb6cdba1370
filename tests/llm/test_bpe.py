import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ENCODER = bpe.Encoder(*bpe.read_vocabulary())
DECODER = bpe.Decoder(bpe.read_vocabulary()[0])


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdein stréß日本\n\t 0123'<|>", max_size=80))
def test_same_ids_and_round_trip(reference, text):
    ids = ENCODER.encode(text)
    assert ids == reference(text) and ENCODER.count(text) == len(ids) and DECODER.decode(ids) == text


def test_vocabulary_tokens(reference):
    rng = random.Random(1)
    tokens = [t.decode() for t in bpe.read_vocabulary()[0] if t.isascii()]
    for _ in range(3000):
        text = "".join(rng.choices(tokens, k=6))
        assert ENCODER.encode(text) == reference(text)


def test_long_and_special(reference):
    text = "a" * 60_000 + "<|endoftext|>" + " " * 5_000 + "hello" * 5_000
    ids = ENCODER.encode(text)
    assert ids == reference(text) and 50256 not in ids and DECODER.decode(ids) == text


def test_table(spark):
    data = [(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (1, "a b", "x"), (4, "<|endoftext|>", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect())
    assert got[0] == got[1] == (1, ENCODER.encode("a b")) and got[2:4] == [(2, []), (3, [])] and 50256 not in got[4][1]
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}[2] == 0
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect()}
    assert back == {1: "a b", 2: "", 3: "", 4: "<|endoftext|>"}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_caches_are_renewed(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_PIECES", 5)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 5)
    text = "the quick brown fox jumps over supercalifragilistic dogs and cats"
    assert bpe.Encoder(*bpe.read_vocabulary()).encode(text) == ENCODER.encode(text)


def test_file_is_dense():
    model = json.load(open(bpe.VOCABULARY, encoding="utf-8"))["model"]
    assert len(bpe.read_vocabulary()[0]) == len(model["merges"]) + 256


def test_other_ways_to_cut_texts_are_refused(tmp_path):
    whole = json.load(open(bpe.VOCABULARY, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**whole["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None}):
        (tmp_path / "v.json").write_text(json.dumps({**whole, **change}), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.read_vocabulary(str(tmp_path / "v.json"))
