"""Packing: what is done once per worker and per shard, with the same pieces."""

import numpy as np
import public_tokenizers as P

from pairmatch.llm import packing
from pairmatch.llm.packing import Bm25, pack_shard


def shard():
    rng = np.random.default_rng(9)
    return [rng.zipf(1.3, rng.integers(1, 90)).clip(0, 499).astype(np.uint32) for _ in range(150)]


def test_used_documents_leave_the_index():
    """Postings of used documents go as the shard is packed; the others are found as before."""
    docs = shard()
    whole, less = (Bm25(docs, 500, 1.2, 0.75) for _ in range(2))
    unused = np.arange(len(docs)) % 3 == 0
    less.forget(unused)
    assert 0 < len(less.p_doc) < len(whole.p_doc) and less.held == unused.sum()
    assert all(less.neighbours(i, unused) == whole.neighbours(i, unused) for i in range(len(docs)))


def test_pieces_do_not_change(monkeypatch):
    docs, scanned = shard(), []
    find = Bm25.neighbours
    monkeypatch.setattr(Bm25, "neighbours", lambda self, *a: scanned.append(len(self.p_doc)) or find(self, *a))
    got = list(pack_shard(docs, Bm25(docs, 500, 1.2, 0.75), 64))
    assert scanned[-1] < 0.5 * scanned[0]
    monkeypatch.setattr(Bm25, "forget", lambda *_: None)
    assert got == list(pack_shard(docs, Bm25(docs, 500, 1.2, 0.75), 64))


def test_the_best_come_first(monkeypatch):
    """A few neighbours are the first of all; where more are taken, the pieces are the same."""
    docs = shard()
    index, unused = Bm25(docs, 500, 1.2, 0.75), np.arange(len(docs)) % 5 != 0
    for seed in range(0, len(docs), 5):
        few, every = index.neighbours(seed, unused, 4), index.neighbours(seed, unused)
        assert few == every[:len(few)] and len(few) >= min(4, len(every))
    want = list(pack_shard(docs, Bm25(docs, 500, 1.2, 0.75), 512))
    monkeypatch.setattr(packing, "FEW", 2)
    assert want == list(pack_shard(docs, Bm25(docs, 500, 1.2, 0.75), 512))


def test_a_worker_keeps_its_encoder():
    path = P.path("word_bpe_49k.json")
    first = packing.shared_encoder(path, 1)
    assert packing.shared_encoder(path, 1) is first
    assert packing.shared_encoder(path, 2).end == 2 and packing.shared_encoder(path, 1).end == 1
    packing.drop_encoder()
    assert packing.shared_encoder(path, 1) is not first
    packing.drop_encoder()


def test_recent_runs_are_known():
    """Runs learned last are kept apart until they are merged; both are found."""
    enc = packing.Encoder(P.path("word_bpe_49k.json"))
    want = []
    for k in range(3):
        texts = packing.pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'abc'[k]}{chr(97 + i // 676)}" for i in range(12000))])
        want.append((texts, enc.encode(texts)[0].tolist()))
    assert len(enc.known[0]) and len(enc.recent[0])
    runs = enc.runs
    assert all(enc.encode(t)[0].tolist() == w for t, w in want) and enc.runs == runs
    fresh = packing.Encoder(P.path("word_bpe_49k.json"))
    assert fresh.encode(want[2][0])[0].tolist() == want[2][1]
