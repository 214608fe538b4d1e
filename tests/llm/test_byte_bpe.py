from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.llm import byte_bpe

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def pair(name):
    bpe = byte_bpe.vocabulary(public_tokenizers.path(name))
    return bpe, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}
    )


@pytest.mark.parametrize("name", FILES)
def test_random_texts_as_the_library(name):
    bpe, library = pair(name)
    rnd, tokens = random.Random(4), list(bpe.ranks)
    for _ in range(500):
        raw = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 12)))
        text = raw.decode("utf-8", "ignore") + "".join(rnd.choice("aab ") for _ in range(40))
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    bpe, library = pair(FILES[0])
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_long_pieces_take_linear_time():
    bpe, library = pair(FILES[0])
    for text in ("a" * 30_000, "ab" * 15_000, " " * 20_000):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_a_toy_vocabulary_that_needs_taking_back():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"cd": 258}
    bpe = byte_bpe.ByteBpe(ranks)
    for text in (b"abcd", b"abc", b"bcd", b"aabccd"):
        assert bpe.encode_piece(text) == bpe.merged(text) or ranks.get(text) == bpe.encode_piece(text)[0]


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, "é", None), (2, None, "y"), (3, "", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = sorted(byte_bpe.encode_digests(df).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert len(found) == 5 and found[1] == found[2]
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.ids_sha256 == empty for r in found] == [False, False, False, True, True]
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(df)).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == ["", "", "Hello world", "Hello world", "é"]
    none = byte_bpe.encode_texts(df.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "ids"]
