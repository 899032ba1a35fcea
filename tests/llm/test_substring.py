"""Removal of repeated spans against brute force over all windows."""

import random

import numpy as np

from pairmatch.llm.common import gram_hash
from pairmatch.llm.substring import remove_repeats


def brute(rows, window):
    """Words covered by a window that also starts earlier; rows in the order of doc_id (null last),
    then of the input."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = set(), {}
    for i in order:
        w = (rows[i][1] or "").encode().split()
        gone[i] = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone[i][s:s + window] = True
            seen.add(k)
    return gone


def check(spark, rows, window=20, gram=10):
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, block int, d string").coalesce(1)
    out = remove_repeats(df, window, gram, carry=("doc_id", "block", "d")).collect()
    gone = brute(rows, window)
    want = []
    for i, (d, t) in enumerate(rows):
        w = (t or "").encode().split()
        want.append((str(d), len(w), int(gone[i].sum()), b" ".join(x for x, g in zip(w, gone[i]) if not g).decode()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out) == sorted(want)
    for r in out:
        assert " ".join(r.text.encode().split() and [x.decode() for x in r.text.encode().split()]) == r.kept
        assert sum(s.length for s in r.spans) == r.n_removed and all(s.length >= window for s in r.spans)
        assert r.block == 1 and r.d == "b"
    return out


def test_small_alphabet(spark):
    rng = random.Random(7)
    base = [rng.choice("ab") for _ in range(400)]
    rows = []
    for i in range(40):
        s = rng.randrange(300)
        mid = base[s:s + rng.randrange(0, 90)]
        rows.append((rng.randrange(30), " ".join([rng.choice("abc") for _ in range(rng.randrange(20))] + mid)))
    check(spark, rows, window=8, gram=4)


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(25))
    q = " ".join(f"v{i}" for i in range(19))
    rows = [(4, p), (2, f"x {p}\ny"), (9, q), (8, q), (3, None), (1, ""), (6, " \n "), (None, p), (None, p), (7, f"{p} {p}"),
            (10, "z " * 60), (11, "a b " * 30), (12, f"{q} w0\n\n{p}")]
    out = {r.doc_id: r for r in check(spark, rows)}
    assert out[2].text == f"x {p}\ny" and out[4].text == "" and out[9].n_removed == 0
    check(spark, [])


def test_untouched_texts_keep_their_white_space(spark):
    (r,) = check(spark, [(1, " a \t b\n\nc ")])
    assert r.text == " a \t b\n\nc "


def test_gram_hashes_are_polynomials():
    h = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    for n in (1, 2, 5, 10, 20, 50, 51):
        want = [sum(int(h[i + j]) * pow(7, n - 1 - j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(max(0, 50 - n + 1))]
        assert gram_hash(h, n, 7).tolist() == want


def test_texts_are_read_again_not_shuffled(spark):
    """Where the answers are too large to broadcast, no exchange carries the blocks' texts."""
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(5)], "doc_id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        q = remove_repeats(df)._jdf.queryExecution()
        plan = q.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set(key, before)
    moved = [part.split("\n")[1] for part in plan.split("\n\n") if ") Exchange" in part]
    assert moved and not any("body" in line for line in moved)
