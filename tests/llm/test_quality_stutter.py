"""Quality rules: words repeated in a row, as a statistic and a feature."""

import numpy as np
import pandas as pd
import pytest

from pairmatch.llm.quality import MAX_GOOD_LOSS, STATS, calibrate, features, fit_forest, quality_rules, rule_stats


def test_stutter_is_seen():
    """Every word seven times: no capitals, no symbols, and no window that occurs twice."""
    plain = [f"w{i:03d}" for i in range(210)]
    texts = [" ".join(plain), " ".join(w for w in plain[:30] for _ in range(7))]
    s = pd.DataFrame([rule_stats(t.encode()) for t in texts], columns=[x.split()[0] for x in STATS.split(", ")])
    assert s["n_same_next"].tolist() == [0, 180] and s["n_repeat_words"].tolist() == [0, 0]
    x = features(s)
    assert (x[0, :-1] == x[1, :-1]).all() and x[0, -1] == 0 and x[1, -1] == 8


@pytest.mark.parametrize("every", [40, 200])
def test_stutter_goes(spark, every):
    """One row in ``every`` repeats each word seven times: all of them go, and of the good rows at most
    the share that calibration may give up."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    rows = [(i, " ".join(np.repeat(rng.choice(words, 40, replace=False), 7) if i % every == 0 else rng.choice(words, 200))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % every > 0)) for i in range(800)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert not any(r.base_failed for r in out.values())
    assert not any(out[i].kept for i in range(0, 800, every))
    assert sum(not out[i].kept for i in range(800) if i % every) <= MAX_GOOD_LOSS * 800


def test_scores_against_walked_trees():
    """Path lengths taken row by row and tree by tree."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 3)), [[9, 9, 9], [-8, 0, 4]]])
    f = fit_forest(x, 25, 64, 1)

    def length(row, at):
        while f.feature[at] >= 0:
            at = f.left[at] if row[f.feature[at]] < f.cut[at] else f.right[at]
        return f.length[at]

    want = [2 ** (-np.mean([length(row, r) for r in f.roots]) / f.norm) for row in x]
    assert np.allclose(f.scores(x), want) and min(want[-2:]) > np.quantile(want[:-2], 0.99)


def test_threshold_against_every_threshold():
    rng = np.random.default_rng(5)
    for _ in range(200):
        bins = [(int(b), int(rng.integers(0, 9)), int(rng.integers(0, 9))) for b in rng.choice(1000, 12, replace=False)]
        good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
        gain = {}
        for t, _, _ in bins:
            lost, caught = sum(g for b, g, _ in bins if b >= t), sum(x for b, _, x in bins if b >= t)
            if good and bad and lost <= 0.1 * good:
                gain[t] = caught / bad - lost / good
        top = max(gain.values(), default=0)
        want = max(t for t in gain if gain[t] == top) / 1000 if top > 0 else np.inf
        assert calibrate(bins, 0.1) == want
