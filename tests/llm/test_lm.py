"""The Pitman-Yor model: seating, probabilities, and the scores of small corpora."""

import collections
import math
import zlib

import numpy as np

from pairmatch.llm import lm
from pairmatch.llm.common import mix


def plain_tables(c, a, grow, d, rng):
    t = 1
    for j in range(1, c):
        new = a + grow * t
        t += rng.random() < new / (j - d * t + new)
    return t


def test_seating_as_one_by_one():
    rng, n = np.random.default_rng(1), 4000
    for c, a, grow, d in ((5, 0.8, 0.1, 0.5), (60, 0.8, 0.1, 0.5), (400, 2.0, 0.0, 0.75), (3000, 40.0, 0.05, 0.75), (500, 0.01, 0.0, 0.75)):
        want = [plain_tables(c, a, grow, d, rng) for _ in range(n)]
        seed = mix(np.arange(n, dtype=np.uint64) + np.uint64(c))
        t, _ = lm.seat(np.full(n, c), np.full(n, a), np.full(n, grow), d, seed)
        assert abs(t.mean() - np.mean(want)) < 5 * np.std(want) / math.sqrt(n) + 0.015 * np.mean(want)
        assert abs(t.std() - np.std(want)) < 0.12 * np.std(want) + 0.02


def test_gibbs_samples_the_posterior():
    """Two dishes' worth of enumeration: P(t) of c = 3 customers is known in closed form."""
    a, d, n = 0.7, 0.4, 60000
    # weights of the seatings by number of tables: products of (a) and (size - d)
    w = {1: (1 - d) * (2 - d), 2: a * (1 - d) * 3, 3: a * a}
    t = lm.gibbs(np.full(n, 3), np.full(n, a), np.zeros(n), d, mix(np.arange(1, n + 1, dtype=np.uint64)), 12)[-1]
    for k in w:
        assert abs((t == k).mean() - w[k] / sum(w.values())) < 0.012


def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        w, x = [], 0
        for _ in range(rng.integers(0, 40)):
            x = (x * 3 + rng.integers(0, 4)) % 37
            w.append(f"W{x}" if i % 2 else f"w{x}")
        rows.append((i, " ".join(w)))
    return rows + [(1000, None), (1001, " \n"), (None, "w1 w2"), (5, rows[5][1]), (1002, "unseen words only"), (1003, "long " * 20000)]


def test_scores(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(3)
    out = lm.score_texts(df).collect()
    assert len(out) == len(rows)
    toks = [(d, (t or "").encode().lower().split() + [None], d is None or zlib.crc32(str(d).encode()) % 10 == 0) for d, t in rows]
    count = collections.Counter(w for _, ws, held in toks if not held for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held, len(ws), sum(count[w] > 0 for w in ws), n,
                   round(sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in ws), 6)) for d, ws, held in toks)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)      # the context helps
    assert all(r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in out)


def test_probabilities_add_up():
    """Given one context, the probabilities of all tokens and of one unknown word sum to one."""
    import zstandard
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(6)
    train = [(i, " ".join(rng.choice(words, 30))) for i in range(1, 80) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    probe = " ".join(f"w3 {w}" for w in [*words, "never"]) + " w3"
    texts = [t.encode() for _, t in [*train, (held, probe)]]
    tok = lm.Tokens([str(d) for d, _ in train] + [str(held)], zstandard.ZstdCompressor().compress(b"".join(texts)),
                    np.array([len(t) for t in texts], dtype=np.int64).tobytes())
    m = lm.Model.__new__(lm.Model)
    m.tok, m.seed, m.c, m.cp, m.own, m.round = tok, 1, tok.words_n, tok.pairs_n, 1, 0
    m.total = {"n": int(m.c.sum()), "v": int((m.c > 0).sum()), "rounds": 0}
    for r in (1, 2):
        state = m.tables()
        sums = m.sums(state)
        root = [lm.root_tables(w, tok.keys, m.total) for w in sums[1::2]]
        m.last, m.state, m.round = np.array(list(zip(sums[::2], sums[1::2], root))), state, r
        m.total |= {"customers": [int(w.sum()) for w in sums[1::2]], "tables": [int(t.sum()) for t in root], "rounds": r}
    logp, _ = m.log10()
    w3 = int(np.flatnonzero(tok.keys == lm.word_hashes(lm.pa.array(["w3"]))[0][0])[0])
    assert len(set(tok.w[tok.u == w3])) == 14
    assert math.isclose((10 ** logp[tok.u == w3]).sum(), 1, rel_tol=1e-9)


def test_empty_table(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
