"""The Pitman-Yor model's owners: a pair is seated by one block, and its tables reach the others."""

import numpy as np
import zstandard

from pairmatch.llm import lm
from pairmatch.llm.common import mix


def tokens(texts, start):
    ids = [str(i) for i in range(start, start + 10 * len(texts)) if lm.zlib.crc32(str(i).encode()) % 10][:len(texts)]
    raw = [t.encode() for t in texts]
    return lm.Tokens(ids, zstandard.ZstdCompressor().compress(b"".join(raw)), np.array([len(t) for t in raw], dtype=np.int64).tobytes())


def test_a_pair_is_seated_by_its_owner(monkeypatch):
    """Two blocks of the same pairs, each owning half of them: together they seat each pair once,
    and their sums are those of one block that owns all."""
    shards, seen = 3, []
    monkeypatch.setattr(lm, "gibbs", lambda c, a, grow, d, seed, n, f=lm.gibbs: seen.append(seed) or f(c, a, grow, d, seed, n))
    tok = tokens(["a b a b a c a b d", "b b c a a d e"] * 30, 0)
    total = {"n": int(2 * tok.words_n.sum()), "v": len(tok.keys), "rounds": 0}
    half = np.arange(len(tok.u)) % 2
    sums = []
    for own in (half, 1 - half, np.ones_like(half)):
        o, order = lm.Owned.of(tok, 2 * tok.pairs_n, own, shards)
        o = lm.Owned.unpack(o.pack(), shards)                # what comes back in the next round
        m = lm.Model(o, total, 1, 2 * tok.words_n[order], o.c)
        sums.append([x + o.base[k % 2] for k, x in enumerate(m.sums(m.tables()))])
    assert (np.array(sums[0]) + sums[1] == sums[2]).all()
    assert not set(seen[0].tolist()) & set(seen[1].tolist())
    assert sorted([*seen[0].tolist(), *seen[1].tolist()]) == sorted(seen[2].tolist())


def test_scores_of_many_blocks(spark, monkeypatch):
    """However the texts are cut into blocks, every pair has the tables that its owner gave it."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 60).clip(0, 400))) for i in range(120)] + [(None, "w1 w2"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = []
    for size in (6 << 20, 1500):
        monkeypatch.setattr(lm, "LM_BLOCK", size)
        monkeypatch.setattr(lm, "SHARD_BYTES", 6000)
        got.append(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lm.score_texts(df).collect()))
    assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]]
    assert np.allclose([x[2] for x in got[0]], [x[2] for x in got[1]], rtol=1e-12)


def test_keys_are_sent_as_steps():
    """A pair's 40 bits take some four bytes or less among ten thousand others; places take one or two."""
    keys = mix(np.arange(1, 20001, dtype=np.uint64))
    sent = lm._messages("pairs", 0, keys, [np.ones(20000)], 2)
    assert sum(len(m[3]) for m in sent) < 4 * 20000
    want = [lm._low(own, 5).tolist() for _, _, own in lm._routes(keys, 2, 5)]
    assert [lm._unpack_keys(m[3], 5).tolist() for m in sent] == want == [sorted(w) for w in want]
    at, mark = np.array([0, 3, 4, 900]), np.array([1, 0, 0, 1])
    back = lm._unpack_places(lm._pack_places(at, mark))
    assert back[0].tolist() == at.tolist() and back[1].tolist() == mark.tolist()
    assert len(lm._unpack_places(lm._pack_places(at[:0]))[0]) == 0
