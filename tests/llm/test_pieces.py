"""Backtracking piece encoding against the sentencepiece library, and decoding of any ids."""

import random

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pairmatch.llm.pieces import Encoder, Model, decode_ids, encode, merge, read_model

PATH = P.path("piece_bpe_32k.model")
ENCODER = Encoder(Model(read_model(PATH)))
TEXTS = [None, "", " ", "\n\n  \n", "<s> hi\n\tthe  café ▁x 日 <0x41> </s><unk>", "▁", "▁▁ a", "it's 12345 !!",
         " " * 15, " " * 40 + "the end ", "日本語のテキスト　です", "🙂🙂 áé x y", "\x00\x07 control", "aaaa" * 900,
         "Étion dans, çouelle üöäß ñ ciónrr", "é ‍ �"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(text, library):
    e = ENCODER
    ids = [i for w in e.words(text) for i in e.encode(w)]
    assert ids == library.encode(text)
    assert decode_ids(e.model, ids) == library.decode(ids)


def test_operator(spark, library):
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(TEXTS + TEXTS[:4])]        # repeated rows too
    out = encode(spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int"), PATH).collect()
    want = [(d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t, _, _ in rows]
    assert sorted(map(repr, ((r.doc_id, r.ids, r.decoded) for r in out))) == sorted(map(repr, want))


def test_empty_table(spark):
    out = encode(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.collect() == []


def test_random_texts(library):
    @settings(max_examples=400, database=None, deadline=None)
    @given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
    def check(t):
        same(t, library)

    check()


def test_spaces_and_pieces(library):
    """Runs of white space marks, whose pieces all have one score, and strings of whole pieces."""
    rng = random.Random(7)
    pieces = list(Model(read_model(PATH)).score)
    for n in range(1, 120):
        same(" " * n + rng.choice(["", "the", "x", "\n"]), library)
    for _ in range(2000):
        same("".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))), library)


def test_long_unbroken_word(library):
    rng = random.Random(3)
    same("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(100_000)), library)


def test_split_is_merging():
    e = ENCODER
    rng = random.Random(5)
    for _ in range(2000):
        w = "".join(rng.choice("▁▁aeinrsthld") for _ in range(rng.randint(1, 18)))
        assert e.split(w) == merge(list(w), e.score)


def test_decode_any_ids(library):
    model = Model(read_model(PATH))
    rng = random.Random(11)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(300) for _ in range(rng.randint(0, 9))]
        assert decode_ids(model, ids) == library.decode(ids)


def test_other_kinds_of_models_are_refused():
    raw = read_model(PATH)
    for other in (b"", raw + b"\x1a\x03\x12\x01x", raw + b"\x0a\x05\x0a\x01x\x18\x05"):   # none; a charsmap; an unused piece
        with pytest.raises(ValueError):
            Model(other)
