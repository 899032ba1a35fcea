"""Rule statistics against plain counting, the forest, and the calibrated threshold."""

import re

import numpy as np

from pairmatch.llm.quality import calibrate, fit_forest, keep_good, quality_rules, repeated_words, rule_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    cover = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)}
    lines, dup, seen = [x for x in t.split("\n") if WORD.search(x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))


TEXTS = [None, "", " \n\t", "é🙂 日本 #x <b>|", "a\nb\na\n \na ", "x " * 30, " ".join("abcdefgh" * 3), "one two\r\none two\r\n", "\x85   a\x0bb"]


def test_statistics():
    for t in TEXTS:
        assert rule_stats(None if t is None else t.encode())[:5] == plain(t), t


def test_repeated_words_at_random():
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, 3, rng.integers(0, 60))
        w = [tuple(ids[i:i + 8]) for i in range(len(ids) - 7)]
        assert repeated_words(ids) == len({i + j for i, x in enumerate(w) if w.count(x) > 1 for j in range(8)})


def test_forest_isolates_the_outlier():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 4)), [[9, 9, 9, 9]]])
    s = fit_forest(x, 100, 128, 1).scores(x)
    assert s.argmax() == 500 and s[500] > 0.65 and np.median(s) < 0.5
    same = fit_forest(np.zeros((50, 4)), 10, 16, 1).scores(np.zeros((3, 4)))
    assert len(set(same)) == 1


def test_threshold():
    assert calibrate([(500, 0, 9), (400, 1, 5), (300, 99, 1)], 0.01) == 0.4
    assert calibrate([(500, 0, 9), (400, 2, 5), (300, 98, 1)], 0.01) == 0.5
    assert calibrate([(300, 9, 0)]) == float("inf") and calibrate([]) == float("inf")


def corpus():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, rng.integers(30, 200)))
        bad = i % 40 == 0
        rows.append((i, " ".join(x + "#" * int(rng.integers(2, 6)) if bad else x for x in w)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_rules(spark):
    rows, labels = corpus()
    rows += [(None, rows[1][1]), (1, rows[1][1]), (1000, None), (1001, "a b"), (1002, "x " * 90), (1003, "long " * 5)]
    docs = spark.createDataFrame([(*r, 3.0, True) for r in rows], "doc_id long, text string, score double, kept boolean")
    lab = spark.createDataFrame(labels + [(2, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, lab, max_good_loss=0.02).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        want = plain(t)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        for r in by[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == failed and not (failed and r.kept)
    bad = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 40 == 0]
    good = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 40]
    assert sum(r.kept for r in bad) <= 2 and sum(not r.kept for r in good) <= 8
    stay = keep_good(docs, lab, max_good_loss=0.02).collect()
    assert sorted(str(r.doc_id) for r in stay) == sorted(str(r.doc_id) for r in out if r.kept)
    assert all(r.score == 3.0 and r.kept for r in stay)          # columns of the input, untouched


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 9 + "### " * 30), (2, "only")], "doc_id long, text string")
    assert {r.doc_id: r.kept == (not r.base_failed) for r in quality_rules(docs).collect()} == {1: True, 2: True}
    assert quality_rules(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).collect() == []
