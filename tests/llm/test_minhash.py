"""BagMinHash: unbiased signatures, classes against brute force, and edge cases."""

import collections
import random

import numpy as np

from pairmatch.llm.minhash import components, keep_one, near_duplicates, shingles, signatures
from pairmatch.llm.common import mix


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = mix(np.arange(1, 61, dtype=np.uint64))
    errors = []
    for k in range(30):
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        b = np.where(rng.random(60) < 0.7, a, b)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sig = [signatures(np.zeros((w > 0).sum(), dtype=np.int64), np.sort(keys + np.uint64(k))[w > 0], w[w > 0], 1, 2000)[0] for w in (a, b)]
        errors.append((sig[0] == sig[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.006 and np.max(np.abs(errors)) < 0.05


def test_signatures_do_not_depend_on_the_block():
    rng = np.random.default_rng(2)
    g, w = np.sort(mix(np.arange(1, 301, dtype=np.uint64))), rng.integers(1, 40, 300)
    one = signatures(np.zeros(300, dtype=np.int64), g, w, 1, 100)
    both = signatures(np.repeat([0, 1], 300), np.concatenate([g, g]), np.concatenate([w, w]), 3, 100)
    assert (both[0] == one[0]).all() and (both[1] == one[0]).all() and np.isinf(both[2]).all()


def bag(t):
    w = (t or "").encode().split()
    n = min(5, len(w))
    return collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else None


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                m = sum((bags[i] & bags[j]).values())
                if m >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - m):
                    root[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    return list(classes.values())


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):                 # near 0.8 on both sides
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((rng.randrange(100), " ".join(w)))
    heavy = "a b c d e " * 60
    rows += [(200, heavy), (201, heavy + "a b c d e"), (202, heavy * 3), (203, "a b"), (204, "a b"), (205, "a b c"), (206, None), (207, ""),
             (208, " \n"), (None, rows[0][1]), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1]), (209, "long " * 30000)]
    rng.shuffle(rows)
    return rows


def test_classes(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, i, 7) for i, r in enumerate(rows)], "doc_id long, text string, uid int, class_id int").repartition(3)
    out = {r.uid: r for r in near_duplicates(df.withColumnRenamed("class_id", "comp"), carry=("doc_id", "uid", "comp")).collect()}
    assert len(out) == len(rows) and all(r.comp == 7 for r in out.values())
    for members in brute(rows):
        ids = [(rows[i][0] is None, rows[i][0] or 0) for i in members]
        name = None if min(ids)[0] else min(ids)[1]
        got = [out[i] for i in members]
        assert {(r.class_id, r.class_size) for r in got} == {(name, len(members))}
        assert sum(r.kept for r in got) == 1 and all(r.doc_id == name for r in got if r.kept)
    stay = keep_one(df).collect()
    assert sorted(r.uid for r in stay) == sorted(u for u, r in out.items() if r.kept)
    assert all((rows[r.uid][1] or "") == r.text and r.class_id == 7 for r in stay)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == [] and keep_one(df).collect() == []


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.uid: r.comp for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_short_texts_have_one_shingle():
    import zstandard
    texts = [b"a b", b"", b"a b c d e f", b"a a a a a a"]
    body = zstandard.ZstdCompressor().compress(b"".join(texts))
    doc, _, w, n = shingles(body, np.array([len(t) for t in texts], dtype=np.int64).tobytes())
    assert doc.tolist() == [0, 2, 2, 3] and w.tolist() == [1, 1, 1, 2] and n == 4
