"""Packing: neighbours at the setting that ``pack`` uses, against BM25 over all of a seed's terms."""

import inspect

import numpy as np

from pairmatch.llm.packing import Bm25, pack


def test_all_terms_of_a_seed():
    rng = np.random.default_rng(8)
    k1, b, n, vocab = 1.2, 0.75, 40, 2000
    docs = [rng.zipf(1.3, rng.integers(50, 300)).clip(0, vocab - 1).astype(np.uint32) for _ in range(n)]
    index = Bm25(docs, vocab, k1, b, inspect.signature(pack).parameters["query_terms"].default)
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=vocab)
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
    mean = np.mean([len(d) for d in docs])
    tf = np.array([np.bincount(d, minlength=vocab) for d in docs], dtype=float)
    lens = np.array([[len(d)] for d in docs])
    w = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / mean))
    for seed in range(n):
        unused = np.arange(n) != seed
        score = w[:, tf[seed] > 0].sum(axis=1)
        got = index.neighbours(seed, unused)
        assert sorted(got) == np.flatnonzero((score > 1e-12) & unused).tolist()
        assert np.allclose(score[got], np.sort(score[got])[::-1])
