"""The encoder against the tokenizers library, and decoding."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe
from lodestone.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", " ", "Hello, world's   end!", "don't can't WE'LL I'D", "x" * 300, "12345 ½ ²", "naïve café é ΑΣ ΌΣΟΣ İstanbul ſt ﬁ",
    "a<|endoftext|>b<|startoftext|> <|endoftext|>", "<|EndOfText|>", "  　x\x1cy\x85z​q", "日本語 한국어 🙂🙂 👩‍👩‍👧", "...!!!'''s''",
    "Ñcióntidad über straße", "\x00\x01 ﻿ à́", "'s't're've'm'll'd 'S",
]


@pytest.fixture(scope="module")
def pair():
    with open(tokenizer_path(), "rb") as f:
        return bpe.WordBpe(f.read()), tokenizers.Tokenizer.from_file(tokenizer_path())


def same(pair, texts):
    own, lib = pair
    lib.no_truncation()
    lib.no_padding()
    for text, (n, ids, decoded) in zip(texts, own.encode_batch(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        got = [int(x) for x in ids.split()]
        assert got == want, text
        assert n == len(want)
        assert decoded == lib.decode(want, skip_special_tokens=False) == own.decode(want)


def test_cases(pair):
    same(pair, TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(pair, texts):
    same(pair, texts)


def test_small_table_of_words(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    pair[0].ids, pair[0].tokens = {}, {}
    for text in TEXTS:
        same(pair, [text])
    same(pair, TEXTS)


def test_rows(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "A b", None), (3, "", 1), (4, "word " * 5000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = {(r.doc_id, r.n_tokens) for r in bpe.encode(docs, tokenizer_path()).collect()}
    assert out == {(1, 0), (None, 2), (3, 0), (4, 5000)}
    assert bpe.digests(docs.limit(0), tokenizer_path()).collect() == []


def test_long_words_by_the_heap(spark):
    """Words without blanks, longer than the scan is meant for, and a special token inside."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdeé中文") for _ in range(n)) for n in (255, 256, 257, 3000, 60_000)] + ["ab<|endoftext|>" + "xy" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    got = {r.doc_id: r.ids for r in bpe.encode(docs, tokenizer_path()).collect()}
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_workers_let_go_of_the_encoder(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(8)], "doc_id long, text string").repartition(4)

    def living(batches):
        import gc

        import pyarrow as pa

        for batch in batches:
            n = sum(type(x).__name__ == "WordBpe" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows)], names=["n"])

    assert bpe.digests(docs, tokenizer_path()).filter("n_tokens > 0").count() == 8
    assert [r.n for r in docs.mapInArrow(living, "n long").collect()] == [0] * 8
