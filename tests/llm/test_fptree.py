"""FP-tree search against scores of every document by brute force."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from pairmatch.llm import fptree
from pairmatch.llm.fptree import Tree, score_parts, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, rank int"
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    tfs = [Counter(words(t)) for _, t in docs]
    n_docs, total = sum(bool(c) for c in tfs), sum(sum(c.values()) for c in tfs)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c in zip(docs, tfs):
            if c:
                m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
                s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if c[t])
                if s > 0:
                    found.append((-s, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return out


def corpus(n, seed=0, vocabulary=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)] + ["Ünïcode", "日本", "A1"]
    common = [max(1, int(200 / (i + 1))) for i in range(len(pool))]
    docs = [(i * 3 % 1009, " ".join(rng.choices(pool, common, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(5000 + i, docs[3][1] + " w5 w6 w59") for i in range(n // 3)]     # a group of copies
    docs += docs[:4]                                                            # repeated rows
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(25)]
    return docs, items


def check(spark, docs, items, k=50):
    d = spark.createDataFrame([(a, t, "x", 1) for a, t in docs], DOCS)
    q = spark.createDataFrame([(a, t, "x") for a, t in items], ITEMS)
    got = sorted(map(tuple, search(d.repartition(5), q, k).collect()), key=repr)
    assert got == sorted(brute(docs, items, k), key=repr)
    return got


def test_against_brute_force(spark):
    check(spark, *corpus(400), k=10)


def test_edge_cases(spark):
    docs, items = corpus(60, seed=3)
    docs += [(None, docs[0][1]), (None, None), (7000, ""), (7001, "  ,;\n"), (7002, "w1 " * 30000), (7003, "W1,w1;w1\x00w1_w1")]
    items += [(None, "w1 W1 w2"), (None, None), (31, ""), (31, "w3 nowhere"), (31, "w3 nowhere"), (32, "nowhere")]
    assert check(spark, docs, items)


def test_empty_tables(spark):
    docs, items = corpus(5)
    assert check(spark, [], items) == check(spark, docs, []) == check(spark, [(1, None)], items) == []


def test_items_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(fptree, "ITEMS", 7)
    check(spark, *corpus(80, seed=5), k=5)


@pytest.mark.parametrize("seed", range(6))
def test_tree_over_shards(seed):
    """Bounds hold and no document is lost, over several shards and with copies."""
    rng = np.random.default_rng(seed)
    width, k = 40, 8
    best, every = [], []
    terms = np.sort(rng.choice(width, 9, replace=False))
    w = rng.integers(0, 3000, len(terms))
    for shard in range(3):
        docs = []
        for i in range(400):
            path = np.flatnonzero(rng.random(width) < 1 / (1 + np.arange(width) / 4))
            docs.append((path if i % 3 else docs[-1][0] if docs else path, shard * 1000 + i))
        docs = [(p, i) for p, i in docs if len(p)]
        tf = [rng.integers(1, 4, len(p)) for p, _ in docs]
        m = rng.integers(50, 200, len(docs))
        tree = Tree([i for _, i in docs], m, np.array([len(p) for p, _ in docs]), np.concatenate([p for p, _ in docs]),
                    np.concatenate(tf), width)
        assert len(tree.start) > 10 and max(e - s for i, (s, e) in enumerate(zip(tree.start, tree.end)) if i not in tree.kids) <= fptree.LEAF
        tree.search(terms, w, best, k)
        for (p, i), t, mm in zip(docs, tf, m):
            own = np.zeros(width, dtype=np.int64)
            own[p] = t
            every.append((-int(score_parts(w, own[None, terms], np.array([mm])).sum()), (False, i)))
    assert best == sorted(x for x in every if x[0] < 0)[:k]


def test_search_leaves_subtrees_out(monkeypatch):
    rng = np.random.default_rng(1)
    paths = [np.flatnonzero(rng.random(60) < 0.1) for _ in range(3000)]
    paths = [p for p in paths if len(p)]
    tree = Tree(list(range(len(paths))), np.full(len(paths), 100), np.array([len(p) for p in paths]), np.concatenate(paths),
                np.ones(sum(map(len, paths)), dtype=np.int64), 60)
    visited = []
    leaf = Tree._leaf
    monkeypatch.setattr(Tree, "_leaf", lambda self, node, *a: (visited.append(node), leaf(self, node, *a)))
    best = []
    tree.search(np.array([0, 1, 2]), np.array([900, 800, 700]), best, 5)
    assert len(best) == 5 and len(visited) < (len(tree.start) - len(tree.kids)) / 2


def test_terms():
    assert terms_of("It's A-b_c 9Ü\x00x\x7fy") == [t.encode() for t in words("It's A-b_c 9Ü\x00x\x7fy")]
    assert terms_of(None) == []
