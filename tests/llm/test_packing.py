"""Packing: every id in exactly one piece, full sequences, and BM25 against the plain formula."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pairmatch.llm.packing import Bm25, Encoder, pack, pack_shard

PATH = P.path("word_bpe_49k.json")
TEXTS = [None, "", "it's a Café, isn't it?! x,, y.; z", "naïve İstanbul ΑΣΣ ﬁ ½ K. é. é. 日本語. a　b ..",
         "<|endoftext|> stays text", "word " * 3000, "the quick brown fox. " * 300, "\t\r\n\x0b", "l'été, c'est l'Été."]


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def direct(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_as_the_tokenizer(tok):
    enc = Encoder(PATH)
    for _ in range(2):                                    # the second time everything is remembered
        assert [x.tolist() for x in enc.encode(pa.array(TEXTS, pa.string()))] == [direct(tok, t) for t in TEXTS]


def check(rows, want, window):
    seqs, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    short = 0
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= window and (at == window or at & (at - 1) == 0)
        short += at < window
    got = []
    for (d, n), pieces in docs.items():
        flat = [i for _, ids in sorted(pieces, key=lambda p: p[0]) for i in ids]
        assert len(flat) % n == 0
        got += [(d, n)] * (len(flat) // n)
    assert sorted(got, key=str) == sorted(((d, len(w)) for d, w in want), key=str)
    return docs


def test_pieces(spark, tok):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, TEXTS[5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").coalesce(1)
    out = pack(df, PATH, window=256, shard_docs=4).collect()
    docs = check(out, [(d, direct(tok, t)) for d, t in rows], 256)
    for d, t in rows:
        w = direct(tok, t)
        pieces = sorted(docs[d, len(w)], key=lambda p: p[0])
        if sum(len(i) for _, i in pieces) == len(w):
            assert [x for _, i in pieces for x in i] == w and [s for s, _ in pieces][0] == 0
    assert pack(df.limit(0), PATH).collect() == []


def test_bm25_neighbours():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.5, rng.integers(1, 60)).clip(0, 49).astype(np.uint32) for _ in range(40)]
    k1, b, n = 1.2, 0.75, len(docs)
    index = Bm25(docs, 50, k1, b, 50)
    df = [sum(t in d for d in docs) for t in range(50)]
    idf = [max(0, np.log((n - f + 0.5) / (f + 0.5))) for f in df]
    mean = sum(map(len, docs)) / n
    for seed in range(n):
        terms = {int(t) for t in docs[seed] if df[t] > 1 and idf[t] > 0}
        score = [sum(idf[t] * (d == t).sum() * (k1 + 1) / ((d == t).sum() + k1 * (1 - b + b * len(d) / mean)) for t in terms) for d in docs]
        want = sorted((d for d in range(n) if score[d] > 1e-12 and d != seed), key=lambda d: (-round(score[d], 9), d))
        unused = np.ones(n, dtype=bool)
        unused[seed] = False
        got = index.neighbours(seed, unused)
        assert sorted(got) == sorted(want)
        assert np.allclose([score[d] for d in got], [score[d] for d in want])


def test_every_id_of_a_shard_once():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30, n).astype(np.uint32) for n in (1, 5, 700, 3, 64, 64, 200, 1)]
    seen = [np.zeros(len(d), dtype=int) for d in docs]
    for d, at, n, _, _ in pack_shard(docs, Bm25(docs, 30, 1.2, 0.75, 16), 64):
        seen[d][at:at + n] += 1
    assert all((s == 1).all() for s in seen)


def test_routes_and_terms_of_many_documents():
    """Whole batches at a time, the same terms, counts and routes as document by document."""
    from pairmatch.llm.packing import Stats, distinct
    rng = np.random.default_rng(8)
    docs = [np.append(rng.integers(2, 40, rng.integers(0, 30)), 1).astype(np.uint16) for _ in range(200)]
    bounds = np.cumsum([0, *map(len, docs)])
    parts = [np.unique(d, return_counts=True) for d in docs]
    doc, term, tf = distinct(np.concatenate(docs), bounds, 50)
    assert term.tolist() == np.concatenate([p[0] for p in parts]).tolist()
    assert tf.tolist() == np.concatenate([p[1] for p in parts]).tolist()
    assert doc.tolist() == np.repeat(np.arange(200), [len(p[0]) for p in parts]).tolist()
    stats = Stats(np.bincount(term, minlength=50), 200, float(np.mean([len(d) for d in docs])))
    got = stats.route(np.concatenate(docs), bounds, 60, 1.2, 0.75)
    for i, (t, k) in enumerate(parts):
        w = stats.weights(t, k, len(docs[i]), 1.2, 0.75)
        wide = np.where(stats.df[t] >= 60, w, 0)
        want = [int(t[wide.argmax()]) if wide.max() > 0 else -1]
        w = np.where(stats.df[t] > 1, w, 0)
        for _ in range(2):
            want.append(int(t[w.argmax()]) if w.max() > 0 else -1)
            w[w.argmax()] = 0
        assert got[:, i].tolist() == want


def test_all_ids_in_one_array(tok):
    """A batch's ids come as one array; runs with marks, digits and other letters are the tokenizer's."""
    texts = ["Hello, world. a. ., 3. été. Ärger, it's x². 你好.", "", None, "don't. stop,,", "ǅ. ́a, İ."]
    ids, bounds = Encoder(PATH).encode_flat(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [direct(tok, t) for t in texts]
