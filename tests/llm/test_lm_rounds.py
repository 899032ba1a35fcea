"""The Pitman-Yor model's rounds: seating against sampled totals, without the first sweep."""

import numpy as np
import zstandard

from pairmatch.llm import lm


def model(texts):
    texts = [t.encode() for t in texts]
    train = [str(i) for i in range(1000) if lm.zlib.crc32(str(i).encode()) % 10][:len(texts)]
    tok = lm.Tokens(train, zstandard.ZstdCompressor().compress(b"".join(texts)),
                    np.array([len(t) for t in texts], dtype=np.int64).tobytes())
    m = lm.Model.__new__(lm.Model)
    m.tok, m.seed, m.c, m.cp, m.own, m.round = tok, 1, tok.words_n, tok.pairs_n, 1, 0
    m.total = {"n": int(m.c.sum()), "v": int((m.c > 0).sum()), "rounds": 0}
    return m


def test_first_sweep_is_thrown_away(monkeypatch):
    swept = []
    monkeypatch.setattr(lm, "gibbs", lambda *a, f=lm.gibbs: swept.append(f(*a)) or swept[-1])
    m = model(["a b a b a c a b"] * 40)
    tables = m.tables()
    many = m.cp > 1
    assert len(tables) == lm.SAMPLES and len(swept[0]) > lm.SAMPLES
    assert all((t[many] == s).all() for t, s in zip(tables, swept[0][-lm.SAMPLES:]))


def test_last_round_seats_against_sampled_totals(spark):
    """A word always followed by the same one: the count's power is far from its tables."""
    rows = [(i, "new york " * 40 + f"word{i % 30}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda **k: {r.doc_id: r.score for r in lm.score_texts(df, **k).collect()}
    assert score() == score(rounds=2) != score(rounds=1)


def test_own_tables_are_not_counted_twice(monkeypatch):
    """With one dish that has several customers, no tables of others weigh in the second round."""
    seen = []
    monkeypatch.setattr(lm, "gibbs", lambda c, a, grow, *x, f=lm.gibbs: seen.append((a, grow)) or f(c, a, grow, *x))
    m = model(["new york " * 200])
    state = m.tables()
    sums = m.sums(state)
    m.last, m.state, m.round = np.array([(u, w, w) for u, w in zip(sums[::2], sums[1::2])]), state, 1
    m.total |= {"customers": [int(w.sum()) for w in sums[1::2]], "tables": [int(w.sum()) for w in sums[1::2]], "rounds": 1}
    m.tables()
    a, grow = seen[-1]
    many = np.flatnonzero(m.cp > 1)
    alone = np.bincount(m.tok.u)[m.tok.u[many]] == 1     # the only dish of its context
    assert alone.any()
    assert np.allclose(a[alone] / grow[alone], lm.STRENGTH / lm.DISCOUNT)


def test_each_round_is_seated_once(spark, monkeypatch):
    """What a block seated comes back to it: two rounds call for two seatings, and scoring for none."""
    m = model(["a b a b a c a b"] * 40)
    state = m.tables()
    sums = m.sums(state)
    m.last, m.state, m.round = np.array([(u, w, w) for u, w in zip(sums[::2], sums[1::2])]), state, 1
    m.total |= {"customers": [int(w.sum()) for w in sums[1::2]], "tables": [int(w.sum()) for w in sums[1::2]], "rounds": 1}
    assert (m.whole(state[:, m.cp > 1]) == state).all()        # what is sent is enough
    seated = []
    monkeypatch.setattr(lm, "gibbs", lambda *a, f=lm.gibbs: seated.append(1) or f(*a))
    m.log10()
    assert not seated
    m.tables()
    assert len(seated) == 1
