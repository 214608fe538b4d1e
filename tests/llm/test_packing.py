from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weir.llm import packing

DOC = "doc_id bigint, text string, start string, `offset` string"


def check(rows, found, length):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = [
        np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t, *_ in rows
    ]
    assert sum(r.length for r in found) == sum(map(len, ids))
    by_id = {}
    for (i, *_), x in zip(rows, ids):
        by_id.setdefault(i, []).append(x)
    sequences = {}
    for r in found:
        options = by_id[r.doc_id]
        assert any(
            len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            for x in options
        )
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for number in range(len(sequences)):
        end = 0
        for offset, n in sorted(sequences[number]):
            assert offset == end
            end += n
        sizes.append(end)
    assert all(n == length or n & (n - 1) == 0 and n < length for n in sizes)
    return sizes


def test_pieces_cover_all_tokens_once(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "Ärger,", "été.", "don't", "x1"]) for _ in range(n)) for n in (0, 1, 9, 700, 90)]
    rows = [(i, t, "", "") for i, t in enumerate(texts * 3)]
    rows += [(None, "null id", "a", "b"), (50, None, None, None), (51, "odd\x1cspace\x85here", "", ""), (3, texts[3], "", "")]
    found = packing.pack(spark.createDataFrame(rows, DOC), length=256).collect()
    sizes = check(rows, found, 256)
    assert sizes.count(256) >= len(sizes) - 8


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOC)).collect() == []


def test_words_are_tokenised_as_whole_texts():
    path = public_tokenizers.path(packing.VOCABULARY)
    words, library = packing.Words(path), Tokenizer.from_file(path)
    for text in ("It's, an ÉTÉ.", "a.b, c,, d ,e", "x　y\x1fz", "<|endoftext|> a", "ΟΔΟΣ. ſ", "1,2. 3"):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode([text])[0], words.kind).tolist() == want


def test_memory_of_words_may_run_full(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 20)
    path = public_tokenizers.path(packing.VOCABULARY)
    words, library = packing.Words(path), Tokenizer.from_file(path)
    for at in range(0, 60, 6):
        text = " ".join(f"Word{i}, w{i % 9}." for i in range(at, at + 12))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode([text])[0], words.kind).tolist() == want


def ids_of(words, texts):
    return [np.frombuffer(ids, words.kind).tolist() for ids in words.encode(texts)]


def test_merges_of_many_words_follow_the_tokenizer():
    path = public_tokenizers.path(packing.VOCABULARY)
    words, library = packing.Words(path), Tokenizer.from_file(path)
    rnd = random.Random(5)
    runs = ["a" * n for n in range(1, 63)]
    runs += ["".join(rnd.choices(letters, k=rnd.randint(1, 31))) for letters in ("ab", "étè", "thein", "qzxjk") for _ in range(900)]
    texts = [" ".join(runs[i::7]) for i in range(7)]
    assert ids_of(words, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_runs_of_letters_are_merged_together(monkeypatch):
    calls = []

    class Counting:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            value = getattr(self.real, name)
            if not callable(value):
                return Counting(value) if name in ("model", "normalizer") else value
            return lambda *a, **k: calls.append(name) or value(*a, **k)

    class Read:
        from_file = staticmethod(lambda path: Counting(Tokenizer.from_file(path)))

    path, library = public_tokenizers.path(packing.VOCABULARY), Tokenizer
    text = " ".join("".join("aeioutnäß"[int(d)] for d in f"{i:o}") + ".,"[i % 2] for i in range(8, 3008))
    want = library.from_file(path).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "Tokenizer", Read)
    words = packing.Words(path)
    calls.clear()
    assert ids_of(words, [text]) == [want]
    assert len(calls) < 20


def test_texts_in_several_groups(monkeypatch):
    monkeypatch.setattr(packing, "CHARS_AT_ONCE", 40)
    path = public_tokenizers.path(packing.VOCABULARY)
    words, library = packing.Words(path), Tokenizer.from_file(path)
    texts = ["", "  ", ", a,", "x\x1cy z", "b" * 63 + "!", "Ж" * 31 + " " + "ж" * 32 + ",", "\u1c89a a\u1c8a. \U0001e030",
             "don't DON'T İI. Ǆ, ﬁ 한글! e\u0301 \u2126", "1a a1 a-b, 'tis it's. 日本語、", "tab\tand\u2028line\u3000end ", "\ufffd\x00a \u200b"]
    assert ids_of(words, texts * 3) == [library.encode(t, add_special_tokens=False).ids for t in texts * 3]
    assert words.encode([]) == []


def test_hilbert_numbers_are_a_path_through_all_cells():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        order = packing.hilbert(grid, bits)
        assert sorted(order.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(order)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_like_texts_become_neighbours(spark):
    rnd = random.Random(8)
    kinds = [[f"{c}{i}" for i in range(30)] for c in ("alpha", "beta", "gamma")]
    rows = [(i, " ".join(rnd.choices(kinds[i % 3], k=120)), "", "") for i in range(90)]
    found = packing.pack(spark.createDataFrame(rows, DOC), length=1 << 20, with_ids=False).collect()
    order = [r.doc_id % 3 for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    same = sum(a == b for a, b in zip(order, order[1:]))
    assert same > 60  # about 30 in random order
