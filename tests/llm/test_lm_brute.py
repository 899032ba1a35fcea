"""The Pitman-Yor model's scores against a plain Chinese-restaurant sampler, customer by customer."""

import zlib
from collections import defaultdict

import numpy as np
import zstandard

from pairmatch.llm import lm


class Restaurant:
    """Tables of each dish as lists of customers."""

    def __init__(self, d, strength, parent):
        self.d, self.strength, self.parent = d, strength, parent
        self.tables, self.n, self.t = defaultdict(list), 0, 0

    def p(self, dish):
        own = self.tables.get(dish, ())
        back = (self.strength + self.d * self.t) * self.parent(dish)
        return (sum(own) - self.d * len(own) + back) / (self.strength + self.n)

    def seat(self, dish, rng):
        """Seat a customer; whether a new table was opened."""
        own = self.tables[dish]
        w = np.array([c - self.d for c in own] + [(self.strength + self.d * self.t) * self.parent(dish)])
        k = int(np.searchsorted(np.cumsum(w), rng.random() * w.sum()))
        self.n += 1
        if k < len(own):
            own[k] += 1
            return False
        own.append(1)
        self.t += 1
        return True

    def leave(self, dish, rng):
        """Take a customer away; whether a table was closed."""
        own = self.tables[dish]
        k = int(np.searchsorted(np.cumsum(own), rng.random() * sum(own)))
        own[k] -= 1
        self.n -= 1
        if own[k]:
            return False
        own.pop(k)
        self.t -= 1
        return True


def sampled(pairs, vocabulary, sweeps, burn, seed):
    """Predictive probabilities of pairs, averaged over the sweeps of a plain Gibbs sampler."""
    rng = np.random.default_rng(seed)
    root = Restaurant(lm.ROOT_DISCOUNT, lm.ROOT_STRENGTH, lambda dish: 1 / (vocabulary + 1))
    context = defaultdict(lambda: Restaurant(lm.DISCOUNT, lm.STRENGTH, root.p))
    for u, w in pairs:
        if context[u].seat(w, rng):
            root.seat(w, rng)
    total = defaultdict(float)
    for s in range(sweeps):
        for i in rng.permutation(len(pairs)):
            u, w = pairs[i]
            if context[u].leave(w, rng):
                root.leave(w, rng)
            if context[u].seat(w, rng):
                root.seat(w, rng)
        if s >= burn:
            for pair in set(pairs):
                total[pair] += context[pair[0]].p(pair[1]) / (sweeps - burn)
    return total


def test_scores_of_a_small_corpus():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(25)]
    weight = 1 / np.arange(1, 26)
    follow = {w: rng.permutation(25) for w in words}
    texts = []
    for _ in range(50):
        t = [words[0]]
        while len(t) < 30:
            t.append(words[follow[t[-1]][rng.choice(25, p=weight / weight.sum())]])
        texts.append(" ".join(t))
    ids = [str(i) for i in range(1000) if zlib.crc32(str(i).encode()) % 10][:len(texts)]
    raw = [t.encode() for t in texts]
    tok = lm.Tokens(ids, zstandard.ZstdCompressor().compress(b"".join(raw)), np.array([len(t) for t in raw], dtype=np.int64).tobytes())
    got = []
    for seed in range(16):
        m = lm.Model.__new__(lm.Model)
        m.tok, m.seed, m.c, m.cp, m.own, m.round = tok, seed, tok.words_n, tok.pairs_n, 1, 0
        m.total = {"n": int(m.c.sum()), "v": int((m.c > 0).sum()), "rounds": 0}
        for r in (1, 2):
            state = m.tables()
            sums = m.sums(state)
            root = [lm.root_tables(w, tok.keys, m.total) for w in sums[1::2]]
            m.last, m.state, m.round = np.array(list(zip(sums[::2], sums[1::2], root))), state, r
            m.total |= {"customers": [int(w.sum()) for w in sums[1::2]], "tables": [int(t.sum()) for t in root], "rounds": r}
        got.append(m.log10()[0])
    pairs = [(int(tok.u[k]), int(tok.w[k])) for k in tok.of]
    plain = sampled(pairs, m.total["v"], 140, 20, 1)
    want = np.array([np.log10(plain[int(u), int(w)]) for u, w in zip(tok.u, tok.w)])
    off = lambda g: np.average(np.abs(g - want), weights=tok.pairs_n)
    together = np.log10(np.mean([10 ** g for g in got], axis=0))
    # in log10 a token, at a mean of -1.1. One run averages two samples: most of what it is off by is
    # their noise, as sixteen runs together show; the rest is the price of seating dishes in parallel
    assert max(map(off, got)) < 0.06 and off(together) < 0.03
    assert abs(np.average(together - want, weights=tok.pairs_n)) < 0.01
