"""Byte-level BPE against the tiktoken library, and the round trip back to bytes."""

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pairmatch.llm import bpe
from pairmatch.llm.bpe import encode, from_chars, load_ranks, to_chars

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n  \n", "it's a test, isn't it? THEY'LL say 12345 times!!", "Étion dans, çouelle üöäß ñ ciónrr",
         "日本語のテキスト　です", "🙂🙂 áé  x y", "<|endoftext|> as text", "a" * 3000, "ab" * 700 + " " * 400 + "x",
         "\t\ttabs\x0b\x0c and\r\nlines ", "supercalifragilisticexpialidocious floccinaucinihilipilification"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def run(spark, texts):
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    return encode(df, PATH, P.PATTERN).collect()


def check(spark, library, texts):
    out = run(spark, texts)
    want = sorted((np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for t in texts)
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in out) == want


def test_as_the_library(spark, library):
    check(spark, library, TEXTS + TEXTS[:3])          # repeated rows too


def test_empty_table(spark):
    assert run(spark, []) == []


def test_random_texts(spark, library):
    texts = []

    @settings(max_examples=120, database=None)
    @given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF), max_size=60))
    def collect(t):
        texts.append(t)

    collect()
    check(spark, library, texts)


def test_characters_of_ids():
    ids = np.array([0, 1, 255, 50255, 300, 7])
    back, counts = from_chars(to_chars(ids, [2, 0, 3, 1]))
    assert back.tolist() == ids.tolist() and counts.tolist() == [2, 0, 3, 1]


@pytest.mark.parametrize("long_word", [2, 256])
def test_merges_of_many_words(library, monkeypatch, long_word):
    """Both ways of merging on words of a few letters, where equal pairs overlap and new pairs rank lower."""
    monkeypatch.setattr(bpe, "LONG_WORD", long_word)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aehinorst e"), n)) for n in rng.integers(1, 60, 3000)] + ["a" * 300, "the" * 200, ""]
    ranks = load_ranks(PATH)
    flat = np.array([ranks[bytes([b])] for w in words for b in w.encode()])
    ids, counts = bpe.merge_words(flat, np.array([len(w.encode()) for w in words]), bpe.Merges(ranks))
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for k, w in enumerate(words):
        assert ids[cuts[k]:cuts[k + 1]].tolist() == library._encode_single_piece(w) if ranks.get(w.encode()) is None and w else True


def test_a_long_word_is_not_quadratic():
    """40,000 letters in one word: the fold took a minute for 8,000."""
    import time
    ranks = load_ranks(PATH)
    rng = np.random.default_rng(1)
    flat = np.array([ranks[bytes([b])] for b in rng.choice(list(b"aehinorst"), 40_000)])
    begun = time.process_time()
    ids, counts = bpe.merge_words(flat, np.array([len(flat)]), bpe.Merges(ranks))
    assert counts.tolist() == [len(ids)] and time.process_time() - begun < 20
