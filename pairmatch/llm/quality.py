"""Quality rules with an isolation forest (operator 6).

Every document gets rule statistics (word, symbol, duplicate-line, repeated-window and
stuttered-word counts).
An isolation forest over ratios of them scores how few random splits isolate a document; the
score above which a document is rejected is calibrated from labelled rows. Two base rules reject
on their own: too few words, and too many words in repeated 8-word windows.

Plan: one map stage computes the statistics (written once: a few numbers per document), the
forest is fitted on a uniform random sample of ``trees * psi`` rows of the whole table (the
method's own subsamples, at most 25,600 rows on the driver), every row is scored in a map stage,
and the threshold comes from a histogram of the scores of *all* labelled rows that pass the base
rules (at most 2 x 1,000 bins on the driver). No text is shuffled; only (doc_id, score) meets the labels.

Null and empty texts have no words, all counts 0, and fail the base rules. Repeated rows get the
same result. A row whose doc_id is null has no label. Labels that are null, or repeated for one
doc_id, do not multiply rows: they only weigh in the calibration. Without labels of both kinds
only the base rules reject. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stored

SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"                       # the symbols of the base statistics
CONTINUATION = bytes(range(0x80, 0xC0))     # bytes that continue a UTF-8 character
UPPER = bytes(range(0x41, 0x5B))
MARKS = b"!?"
WINDOW = 8
TREES, PSI, SEED = 100, 256, 20
BINS = 1000
MAX_GOOD_LOSS = 0.005    # share of good labelled rows that calibration may give up at most

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_upper long, n_marks long, n_same_next long")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows that occur twice or more. Windows are numbered
    exactly by doubling: pairs of equal halves get equal numbers."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    level, width = ids, 1
    while width < window:
        step = min(width, window - width)
        a, b = level[:len(level) - step], level[step:]
        level = np.unique(a.astype(np.int64) * (int(level.max()) + 1) + b, return_inverse=True)[1]
        width += step
    again = np.bincount(level)[level] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def rule_stats(raw: bytes | None) -> tuple:
    """The counts of one text, given as UTF-8 bytes, in the order of ``STATS``."""
    raw = raw or b""
    words = raw.split()
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), len(raw.translate(None, SPACE + CONTINUATION)),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ids), len(raw) - len(raw.translate(None, UPPER)),
            len(raw) - len(raw.translate(None, MARKS)), int((ids[1:] == ids[:-1]).sum()))


def with_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the rule statistics of every row."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([rule_stats(t) for t in b["raw"]], columns=names, dtype="int64")
            out.insert(0, "doc_id", b["doc_id"].values)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw")).mapInPandas(
        lean(run), f"doc_id {kind}, {STATS}")


def features(s: pd.DataFrame) -> np.ndarray:
    """Ratios of the statistics, none of which grows with the document. Of repetition only words equal
    to the word before are seen, in tenths, so that the few of ordinary documents draw no splits; lines and windows are left to the base rules: good documents repeat
    lines as well, which would make them look isolated."""
    words = np.maximum(1, s["n_words"].to_numpy(float))
    chars = np.maximum(1, s["word_chars"].to_numpy(float))
    return np.stack([s["n_symbols"] / words, s["n_upper"] / chars, s["n_marks"] / words, chars / words,
                     np.floor(10 * s["n_same_next"] / words)], axis=1)


@dataclass
class Forest:
    """Trees as flat arrays; a leaf has feature -1 and points to itself."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    depth: int
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 anomalous, below 0.5 ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(x[rows, np.maximum(f, 0)] < self.cut[at], self.left[at], self.right[at])
            total += self.length[at]
        return 2.0 ** (-total / max(1, len(self.roots)) / self.norm)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, trees: int, psi: int, seed: int) -> Forest:
    """Random splits: a feature that varies in the node, a cut uniform between its extremes."""
    rng = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(2, psi)))))
    nodes, roots = [], []

    def grow(rows, level):
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, level + expected_path(len(rows))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if level < depth and len(rows) > 1 and len(varied):
            f = int(rng.choice(varied))
            cut = float(rng.uniform(low[f], high[f]))
            cut = cut if cut > low[f] else float(high[f])
            side = rows[:, f] < cut
            nodes[at][:2] = f, cut
            nodes[at][2] = grow(rows[side], level + 1)
            nodes[at][3] = grow(rows[~side], level + 1)
        return at

    full = len(x) >= trees * psi             # else the trees' samples share rows
    order = rng.permutation(len(x))
    for k in range(trees if len(x) else 0):
        roots.append(grow(x[order[k * psi:(k + 1) * psi] if full else rng.permutation(len(x))[:psi]], 0))
    a = list(zip(*nodes)) if nodes else [[], [], [], [], []]
    return Forest(np.array(a[0], dtype=np.int64), np.array(a[1], dtype=float), np.array(a[2], dtype=np.int64),
                  np.array(a[3], dtype=np.int64), np.array(a[4], dtype=float), np.array(roots, dtype=np.int64),
                  depth, max(1.0, expected_path(min(psi, max(2, len(x))))))


def calibrate(bins: list[tuple[int, int, int]], max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """The threshold that parts the two kinds of labelled rows best (share of bad rows rejected plus
    share of good rows kept), among those that give up at most ``max_good_loss`` of the good ones; the
    highest of equals. ``bins``: (score bin, good rows, bad rows). Above every score if a kind is
    missing or no threshold is better than none."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    threshold, best = np.inf, 0.0
    if good and bad:
        lost = caught = 0
        for b, g, x in sorted(bins, reverse=True):
            lost, caught = lost + g, caught + x
            if lost > max_good_loss * good:
                break
            if caught / bad - lost / good > best:
                threshold, best = b / BINS, caught / bad - lost / good
    return threshold


@dataclass
class Rules:
    """A fitted forest with its threshold, and the base rules."""
    forest: Forest
    threshold: float
    min_words: int
    max_repeat_pct: int

    def base_failed(self, s: pd.DataFrame):
        return (s["n_words"] < self.min_words) | (100 * s["n_repeat_words"] > self.max_repeat_pct * s["n_words"])

    def judge(self, s: pd.DataFrame) -> pd.DataFrame:
        score = self.forest.scores(features(s))
        failed = self.base_failed(s)
        return s.assign(base_failed=failed, score=score, kept=~failed & (np.floor(score * BINS) / BINS < self.threshold))


def fit_rules(stats: DataFrame, labels: DataFrame | None, min_words: int = 20, max_repeat_pct: int = 30,
              trees: int = TREES, psi: int = PSI, seed: int = SEED, max_good_loss: float = MAX_GOOD_LOSS) -> Rules:
    """Fit the forest to a random sample of ``stats`` and calibrate its threshold on all rows of
    ``labels`` (doc_id, quality: 1 good, 0 bad)."""
    # about as many rows as are wanted are picked by their hash before they are ordered, so that
    # what reaches the driver does not grow with the number of partitions
    order, want = F.xxhash64(F.lit(seed), *stats.columns), trees * psi
    share = min(1.0, (want + 6 * want ** 0.5) / max(1, stats.count()))
    picked = stats.filter(F.pmod(order, F.lit(1 << 31)) < int(share * (1 << 31)))
    sample = picked.orderBy(order).limit(want).toPandas()
    rules = Rules(fit_forest(features(sample), trees, psi, seed), float("inf"), min_words, max_repeat_pct)
    if labels is not None:
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = rules.judge(b)
                b = b[~b["base_failed"]]
                yield pd.DataFrame({"doc_id": b["doc_id"], "bin": np.floor(b["score"] * BINS).astype("int64")})

        kind = stats.schema["doc_id"].dataType.simpleString()
        own = stats.filter(F.col("doc_id").isNotNull()).mapInPandas(lean(score), f"doc_id {kind}, bin long")
        hist = (own.join(labels.filter(F.col("quality").isNotNull()).select("doc_id", "quality"), "doc_id")
                .groupBy("bin").agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"),
                                    F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad")))
        rules.threshold = calibrate([(r["bin"], r["good"], r["bad"]) for r in hist.collect()], max_good_loss)
    return rules


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, **params) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``score`` and ``kept`` of every row of ``docs``."""
    stats = stored(with_stats(docs), "rule-stats")
    rules = fit_rules(stats, labels, **params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rules.judge(b)

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInPandas(lean(run), f"doc_id {kind}, {STATS}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, **params) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    rules = fit_rules(stored(with_stats(docs), "rule-stats"), labels, **params)
    names = [x.split()[0] for x in STATS.split(", ")]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                s = pd.DataFrame([rule_stats(t) for t in part.column(at).cast(pa.binary()).to_pylist()], columns=names)
                yield part.filter(pa.array(rules.judge(s)["kept"].to_numpy(bool)))

    return docs.mapInArrow(lean(run), docs.schema)
