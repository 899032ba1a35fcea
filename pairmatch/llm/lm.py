"""Language-model scoring with a hierarchical Pitman-Yor model (operator 1).

A bigram model: every single word is a context with a restaurant of its own, in which the words that
follow it are seated. There are no longer contexts. All context restaurants share one parent, the
root restaurant of single words, whose base is uniform over the vocabulary and one unknown word. A dish (following word) of a context with c
customers sits at t tables, and each table is a customer of the root.

Seating is sampled by Gibbs, dish by dish: all customers of a dish are seated anew by the Chinese
restaurant's sequential rule given the tables of all other dishes, and the new seating is accepted
by the ratio of the sequential weights (Metropolis within Gibbs). A round samples all dishes of all
restaurants in parallel against the table totals of the round before (at first: estimates from the
counts), less the dish's own. A round takes three sweeps, of which the first (the proposal as it
comes) is thrown away; the totals of the others are then summed and the root's own seating is
sampled. There are two rounds, so the last one seats against sampled totals. Each kept sweep of the last round gives one sample of the predictive probabilities, and a
text's score is the sum of log10 of their averages.

Plan. Blocks of documents and shards of hashed keys exchange messages: blocks send the counts of
their distinct words and word pairs, shards answer with corpus totals and keep the places of each
block's keys, so keys are sent once. One block owns a pair, and only its owner seats it: in every
round blocks send the tables of the pairs they own, by context and by word, and get the totals of
their words. After the last round the owners' tables go through the shards to every block that meets
the pair. What an owner needs in the next round (its pairs' places, counts, hashes and tables) comes
back to it with the answers, so texts are opened for the counts, the first round and the scores
only. Customers past a dish's first 32 are seated in runs (see ``seat``). Draws are made by hashing
the pair, so it does not matter who owns it. A frequent word or pair is one entry per block. The
blocks are stored in buckets by block number, so they are read, never shuffled. The number of shards
grows with the text; only a handful of totals reach the driver.

Words are hashed to 64 bits, word pairs to 40 bits inside a shard. A null or empty text is its end token
alone. A row of a null doc_id is held out. Repeated rows are separate texts. An empty table gives an
empty result; of the other columns only those in ``carry`` are kept; one named like a result column is refused.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_words, blocks, lean, lean_group, mix, open_block, refuse_clash, stored, total_size, word_hashes

ROUNDS = 2                                 # rounds of sampling against the totals of the round before
BURN_IN = 1                                # first Gibbs sweeps of a round, which are thrown away
SAMPLES = 2                                # sweeps after them, each of which is a sample
DISCOUNT, STRENGTH = 0.75, 1.0            # of the context restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 1.0
SHARD_BYTES = 8 << 20
LM_BLOCK = 6 << 20
EACH = 32                                  # customers of a dish that are seated one by one
STEP = 0x9E3779B97F4A7C15
U, WRAP = np.uint64, 1 << 64
END = U(0x5851F42D4C957F2D)                # hash of the end token
MESSAGE = "kind string, shard long, block long, keys binary, values binary"
REPLY = "kind string, block long, shard long, values binary, stats array<bigint>"


def _pack(a: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the planes that are mostly zero take next to nothing."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return _numbers(zstandard.ZstdDecompressor().decompress(b), np.dtype(kind))


def _numbers(raw: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _key_bytes(kind: str) -> int:
    """Bytes of a key in a shard: pairs are known by 40 bits, words by all 64."""
    return 5 if kind == "pairs" else 8


def _low(m: np.ndarray, width: int) -> np.ndarray:
    return m & U((1 << 8 * width) - 1)


def _pack_keys(keys: np.ndarray, width: int) -> bytes:
    """Ascending keys of ``width`` bytes each, as the steps from one to the next."""
    low = _low(keys, width)
    return _pack(np.concatenate([low[:1], np.diff(low)]).astype("<u8"))


def _unpack_keys(b: bytes, width: int) -> np.ndarray:
    return _low(np.cumsum(_unpack(b, "<u8"), dtype=np.uint64), width)


def _pack_places(at: np.ndarray, mark=0) -> bytes:
    """Ascending places, each with a mark of one bit."""
    return _pack((np.diff(at, prepend=0) << 1 | mark).astype("<u8"))


def _unpack_places(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = _unpack(b, "<u8").astype(np.int64)
    return np.cumsum(steps >> 1), (steps & 1).astype(bool)


def _narrow(totals: np.ndarray) -> np.ndarray:
    """32-bit numbers where all fit, else 64-bit ones."""
    return totals.astype("<u4" if totals.max(initial=0) < 1 << 32 else "<u8")


def _routes(keys: np.ndarray, shards: int, width: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places of its keys, their scrambled keys), always in the same order: by shard, then
    by the ``width`` bytes that a key is known by there."""
    m = mix(keys)
    shard = (m >> U(40)) * U(shards) >> U(24)
    order = np.argsort(m if width == 8 else shard << U(8 * width) | _low(m, width))
    m, shard = m[order], shard[order].astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(m)]])
    for i, j in zip(cuts[:-1], cuts[1:]):
        if i < j:
            yield int(shard[i]), order[i:j], m[i:j]


def _messages(kind: str, block: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> list[tuple]:
    width = _key_bytes(kind)
    return [(kind, s, block, _pack_keys(own, width), _pack(np.concatenate([c[p] for c in columns]).astype("<u4")))
            for s, p, own in _routes(keys, shards, width)]


def _values(b: bytes, width: int, n: int) -> np.ndarray:
    """``width`` columns of ``n`` numbers each, of 32 or 64 bits."""
    raw = zstandard.ZstdDecompressor().decompress(b)
    return _numbers(raw, np.dtype("<u4" if len(raw) == 4 * width * n else "<u8")).reshape(width, n)


def _read(replies, keys: np.ndarray, width: int, shards: int, key_bytes: int = 8, only: np.ndarray | None = None) -> list[np.ndarray]:
    """The columns of all shards' answers, by key; of keys not ``only`` asked for, nothing came."""
    got = {r["shard"]: r["values"] for r in replies or []}
    out = [np.zeros(len(keys), dtype=np.int64) for _ in range(width)]
    for s, p, _ in _routes(keys, shards, key_bytes):
        if only is not None:
            p = p[only[p]]
        if len(p):
            for o, v in zip(out, _values(got[s], width, len(p))):
                o[p] = v
    return out


def seat(c: np.ndarray, a: np.ndarray, grow: np.ndarray, d: float, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seat ``c`` customers of each dish one after another: a new table weighs ``a`` plus ``grow`` for
    each table the dish already has, its tables together their customers less ``d`` each. Returns
    the tables and the log weight of the seating.

    The first ``EACH`` customers sit down one by one. Later ones come in runs of an eighth of those
    already seated; in a run the weights change with the customers, but with the tables only from
    run to run, so a dish of a million customers takes some ninety steps."""
    order = np.argsort(-c, kind="stable")                # those still to be seated stand in front
    falling, a, grow, seed = -c[order], a[order], grow[order], seed[order]
    t, logw = np.ones(len(c)), np.zeros(len(c))
    j = 1
    while j < EACH and (n := np.searchsorted(falling, -j)):   # customer j + 1 of n dishes
        new = grow[:n] * t[:n] + a[:n]
        both = new + j - d * t[:n]
        logw[:n] += np.log(both)
        t[:n] += _uniform(mix(seed[:n] + U(j * STEP % WRAP))) * both < new
        j += 1
    k = j                                                # k customers sit
    while n := np.searchsorted(falling, -k):
        run = np.minimum(-falling[:n] - k, max(1, k // 8))
        new, old = grow[:n] * t[:n] + a[:n], k - d * t[:n]
        grown = np.log1p(run / (old + new - 0.5))        # sum over the run of 1 / (weight of all tables)
        opened = _count(run, np.minimum(1.0, new * grown / run), mix(seed[:n] + U(k * STEP % WRAP)))
        logw[:n] += run * np.log(old + new + (run - 1) / 2)
        t[:n] += opened
        k += max(1, k // 8)
    out = np.empty((2, len(c)))
    out[0, order], out[1, order] = t, logw
    return out[0], out[1]


def _count(n: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A binomial draw for each (n, p): by inversion where few successes (or failures) are
    expected, else by the normal distribution."""
    flip = p > 0.5
    q = np.where(flip, 1 - p, p)
    u = _uniform(r)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(mix(r)))
    out = np.clip(np.rint(n * q + z * np.sqrt(n * q * (1 - q))), 0, n)
    few = np.flatnonzero(n * q < 12)
    if len(few):
        m, s = n[few].astype(float), q[few]
        term = (1 - s) ** m
        total, x, left = term.copy(), np.zeros(len(few)), u[few]
        odds = s / (1 - s)
        for i in range(60):
            more = (left > total) & (x < m)
            if not more.any():
                break
            term = term * odds * np.maximum(0, m - i) / (i + 1)
            x = np.where(more, x + 1, x)
            total = np.where(more, total + term, total)
        out[few] = x
    return np.where(flip, n - out, out)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def gibbs(c: np.ndarray, a: np.ndarray, grow: np.ndarray, d: float, seed: np.ndarray, sweeps: int) -> list[np.ndarray]:
    """Tables of each dish after every sweep; the first seating is taken as it comes."""
    t, w = seat(c, a, grow, d, mix(seed))
    states = [t]
    for k in range(1, sweeps):
        other, w2 = seat(c, a, grow, d, mix(seed + U(k)))
        take = np.log(_uniform(mix(seed ^ U(0xA0761D6478BD642F + k)))) < w2 - w
        t, w = np.where(take, other, t), np.where(take, w2, w)
        states.append(t)
    return states


class Tokens:
    """The tokens of one block: its words (the last one the end token), its distinct pairs of a
    context and a token, and their counts in training texts."""

    def __init__(self, ids: list, body: bytes, lens: bytes):
        words, distinct, n = block_words(pc.ascii_lower(open_block(body, lens)))
        self.keys = np.append(word_hashes(distinct)[0] if len(distinct) else np.empty(0, dtype=U), END)
        self.n = n + 1                                   # with the end token
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        size, end = int(self.first[-1]), len(self.keys) - 1
        self.held = np.array([d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d in ids], dtype=bool)
        last = np.zeros(size, dtype=bool)
        last[self.first[1:] - 1] = True
        self.word = np.full(size, end, dtype=np.int64)
        self.word[~last] = words
        before = np.full(size, end, dtype=np.int64)
        before[1:] = self.word[:-1]
        self.train = np.repeat(~self.held, self.n)
        self.words_n = np.bincount(self.word[self.train], minlength=len(self.keys))
        pair, self.of = np.unique(before * len(self.keys) + self.word, return_inverse=True)
        self.u, self.w = pair // len(self.keys), pair % len(self.keys)
        self.pairs_n = np.bincount(self.of[self.train], minlength=len(pair))
        self.pair_keys = mix(self.keys[self.u] + U(0x2545F4914F6CDD1D)) * U(3) + self.keys[self.w]


class Owned:
    """The pairs of a block that it owns and that have several customers, and what the others it
    owns add to the sums. Words and pairs stand in the order in which they are sent to the shards;
    ``words`` and ``pairs`` are how many go to each."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, arrays: list[np.ndarray]):
        self.words, self.pairs = words, pairs
        self.u, self.w, self.c, self.pair_keys, self.tables, *self.base = arrays
        self.keys = range(int(words.sum()))

    @classmethod
    def of(cls, tok: Tokens, cp: np.ndarray, own: np.ndarray, shards: int) -> tuple[Owned, np.ndarray]:
        """And the order of the words."""
        words, pairs, order, mine = np.zeros(shards, dtype=np.int64), np.zeros(shards, dtype=np.int64), [], []
        for s, p, _ in _routes(tok.keys, shards):
            words[s] = len(p)
            order.append(p)
        many = (cp > 1) & (own > 0)
        for s, p, _ in _routes(tok.pair_keys, shards, _key_bytes("pairs")):
            mine.append(p[many[p]])
            pairs[s] = len(mine[-1])
        order, mine = np.concatenate(order), np.concatenate(mine)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        one = np.flatnonzero((cp == 1) & (own > 0))
        base = [np.bincount(rank[x[one]], minlength=len(rank)) for x in (tok.u, tok.w)]
        return cls(words, pairs, [rank[tok.u[mine]], rank[tok.w[mine]], cp[mine], tok.pair_keys[mine],
                                  np.zeros(len(mine), dtype=np.int64), *base]), order

    def pack(self) -> bytes:
        arrays = [len(self.u)], self.words, self.pairs, self.u, self.w, self.c, self.pair_keys, self.tables, *self.base
        return _pack(np.concatenate([np.asarray(x).astype("<u8") for x in arrays]))

    @classmethod
    def unpack(cls, b: bytes, shards: int) -> Owned:
        a = _unpack(b, "<u8")
        n, size = int(a[0]), int(a[1:shards + 1].sum())
        words, pairs, *arrays = np.split(a[1:], np.cumsum([shards, shards, n, n, n, n, n, size]))
        arrays = [x if i == 3 else x.astype(np.int64) for i, x in enumerate(arrays)]
        return cls(words.astype(np.int64), pairs.astype(np.int64), arrays)


class Model:
    """What is known of the corpus, and the samples of the last round: tables of the pairs in
    ``tok``, and the totals of all blocks."""

    def __init__(self, tok: Tokens | Owned, total: dict, seed: int, c: np.ndarray | None, cp: np.ndarray, last=None, tables=None):
        self.tok, self.total, self.seed, self.c, self.cp, self.own = tok, total, seed, c, cp, 1
        self.round = total["rounds"]
        if self.round:
            # of each sample: tables by context, customers and tables of the root by word
            self.last = np.reshape(last, (SAMPLES, 3, -1))
            self.state = self.whole(tables[None] / SAMPLES)    # the samples' mean

    def whole(self, kept: np.ndarray) -> np.ndarray:
        """Tables of all pairs from those of pairs with several customers: one customer has one table."""
        out = np.tile(np.minimum(self.cp, 1).astype(float), (len(kept), 1))
        out[:, self.cp > 1] = kept
        return out

    def root(self, k: int) -> np.ndarray:
        """The root's probability of each word after the last round, by sample k (or at the start)."""
        if not self.round:
            return (self.c + 1 / (self.total["v"] + 1)) / (self.total["n"] + 1)
        t, tables = self.total["customers"][k], self.total["tables"][k]
        _, w, wt = self.last[k]
        return (w - ROOT_DISCOUNT * wt + (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (self.total["v"] + 1)) / (ROOT_STRENGTH + t)

    def tables(self) -> np.ndarray:
        """Tables of each pair in the samples of the next round, given the totals of the last one."""
        tok, r = self.tok, self.round + 1
        if r == 1:
            others = (self.c.astype(float) ** DISCOUNT)[tok.u] - 1
        else:                                            # the context's tables less the pair's own
            others = self.last[:, 0].mean(axis=0)[tok.u] - self.state.mean(axis=0)
        start = np.minimum(self.cp, 1).astype(float)
        many = np.flatnonzero(self.cp > 1)
        p = self.root(0)[tok.w[many]]
        weight = STRENGTH + DISCOUNT * np.maximum(0.0, others[many])
        states = gibbs(self.cp[many], weight * p, DISCOUNT * p, DISCOUNT,
                       tok.pair_keys[many] ^ U((self.seed * 1000 + r) * STEP % WRAP), BURN_IN + SAMPLES)[BURN_IN:]
        out = []
        for t in states:
            out.append(start.copy())
            out[-1][many] = t
        return np.stack(out)

    def sums(self, tables: np.ndarray) -> list[np.ndarray]:
        """Per sample, the tables per context and per word of the pairs this block owns."""
        n = len(self.tok.keys)
        return [np.bincount(x, weights=t * self.own, minlength=n).astype(np.int64)
                for t in tables for x in (self.tok.u, self.tok.w)]

    def log10(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair, the predictive probability averaged over the last round's samples; of each
        word, the base."""
        tok = self.tok
        total = (self.cp - DISCOUNT * self.state.mean(axis=0)) / (STRENGTH + self.c[tok.u])
        for k in range(SAMPLES):
            back = (STRENGTH + DISCOUNT * self.last[k][0]) / (STRENGTH + self.c)
            total = total + back[tok.u] * self.root(k)[tok.w] / SAMPLES
        base = (self.c + 0.1) / (self.total["n"] + 0.1 * (self.total["v"] + 1))
        return np.log10(total), np.log10(base)


def score_texts(docs: DataFrame, rounds: int = ROUNDS, seed: int = 1, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns (doc_id among them), ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` of every row."""
    carry = list(dict.fromkeys(["doc_id", *carry]))
    refuse_clash(carry, ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"))
    parts = blocks(docs.select(*carry, *[c for c in ["text"] if c not in carry]), carry, "lm-blocks", rows=100_000,
                   size=LM_BLOCK, bucketed=True)
    shards = max(1, total_size(parts) // SHARD_BYTES)
    parts = parts.withColumn("ids", F.transform("d", lambda x: x["doc_id"].cast("string")))

    def rows(some: list[tuple]) -> pa.RecordBatch:
        types = pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)],
                                          names=["kind", "shard", "block", "keys", "values"])

    def ask(df: DataFrame, send) -> DataFrame:
        """``send(block, ids, body, lens, replies)`` of every block of ``df``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block, *text, got = (c[i].as_py() for c in batch.columns)
                    yield rows(send(block, *text, of_kinds(got)))
        return df.mapInArrow(lean(run), MESSAGE)

    def of_kinds(got) -> dict[str, list]:
        out = {}
        for r in got or []:
            out.setdefault(r["kind"], []).append(r)
        return out

    def reply(kind: str, b, shard: int, out: list[np.ndarray], n: list[int], stats: list[int]) -> pd.DataFrame:
        """Each block's part of the columns ``out``; sums of the shard stand in its first row."""
        values = [_pack(x) for x in np.split(_narrow(np.stack(out)), np.cumsum(n)[:-1], axis=1)]
        stats = [int(x) for x in stats] + [0] * (2 * SAMPLES - len(stats))
        return pd.DataFrame({"kind": kind, "block": b, "shard": shard, "values": values, "stats": [stats] + [[0] * len(stats)] * (len(n) - 1)})

    def keep(kind: str, b, shard: int, values: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"kind": f"{kind} kept", "block": b, "shard": shard, "values": values, "stats": [[0] * (2 * SAMPLES)] * len(values)})

    def count(b: pd.DataFrame) -> pd.DataFrame:
        """Totals of each key over all blocks, to be sent back to the blocks, sums over all keys, and
        where each block's keys stand, to be kept."""
        kind, shard = b["kind"].iloc[0], int(b["shard"].iloc[0])
        b = b.sort_values("block")
        b = b.iloc[np.roll(np.arange(len(b)), shard)]    # so that all blocks own some pairs
        keys = [_unpack_keys(k, _key_bytes(kind)) for k in b["keys"]]
        n = [len(k) for k in keys]
        cuts = np.cumsum(n)[:-1]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([_unpack(v, "<u4") for v in b["values"]])).astype(np.int64)
        if kind == "words":
            held = [_pack_places(a) for a in np.split(at, cuts)]
            return pd.concat([reply(kind, b["block"], shard, [sums[at]], n, [sums.sum(), (sums > 0).sum()]),
                              keep(kind, [*b["block"], -1], shard, [*held, _pack_keys(distinct, 8)])])
        first = np.empty(len(distinct), dtype=np.int64)  # the first block that sends a pair owns it
        first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        own = np.bincount(first, minlength=len(at))
        place = np.cumsum(sums > 1) - 1                  # only pairs with several customers are seated
        held = {}
        for i, a, o in zip(b["block"], np.split(at, cuts), np.split(own, cuts)):
            if (many := sums[a] > 1).any():
                held[i] = _pack_places(place[a[many]], o[many])
        return pd.concat([reply(kind, b["block"], shard, [sums[at], own], n, []), keep(kind, list(held), shard, list(held.values()))])

    def answer(totals: dict):
        """Of a round: the totals of each word, and each pair's tables as its owner seated it."""
        def run(b: pd.DataFrame) -> pd.DataFrame:
            kind, shard = b["kind"].iloc[0], int(b["shard"].iloc[0])
            if kind == "state":
                return b[["kind", "block", "shard", "values"]].assign(stats=[[0] * (2 * SAMPLES)] * len(b))
            sent = {i: v for i, v in zip(b["block"], b["values"]) if v is not None}
            kept = {i: k for i, k in zip(b["block"], b["keys"]) if k is not None}
            distinct = _unpack_keys(kept.pop(-1), 8) if kind == "round" else None
            places = {i: _unpack_places(k) for i, k in kept.items()}
            n = [len(p) for p, _ in places.values()]
            at = np.concatenate([p for p, _ in places.values()])
            if kind == "tables":
                tables = np.zeros(at.max(initial=-1) + 1, dtype=np.int64)
                for i, (p, own) in places.items():
                    if i in sent:
                        tables[p[own]] = _unpack(sent[i], "<u4")
                return reply(kind, list(places), shard, [tables[at]], n, [])
            cols = [_unpack(sent[i], "<u4").reshape(-1, m) for i, m in zip(places, n)]
            sums = [np.bincount(at, weights=np.concatenate([c[k] for c in cols])).astype(np.int64) for k in range(2 * SAMPLES)]
            root = [root_tables(w, distinct, totals) for w in sums[1::2]]
            return reply(kind, list(places), shard, [x[at] for trio in zip(sums[::2], sums[1::2], root) for x in trio], n,
                         [x.sum() for pair in zip(sums[1::2], root) for x in pair])
        return run

    def shard_by_shard(messages: DataFrame, run, name: str) -> DataFrame:
        return stored(messages.groupBy("kind", "shard").applyInPandas(lean_group(run), REPLY), name)

    def stats(got: DataFrame, kind: str) -> list[int]:
        return list(got.filter(F.col("kind") == kind).agg(
            *[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)).alias(f"s{k}") for k in range(2 * SAMPLES)]).first())

    def for_blocks(*replies: DataFrame) -> DataFrame:
        got = functools.reduce(DataFrame.unionByName, replies).filter(~F.col("kind").endswith(" kept"))
        return got.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "values")).alias("replies"))

    def with_texts(replies: DataFrame) -> DataFrame:
        return parts.join(replies, "block", "left").select("block", "ids", "body", "lens", "replies")

    def counted(block, ids, body, lens, _) -> list[tuple]:
        tok = Tokens(ids, body, lens)
        return _messages("words", block, tok.keys, [tok.words_n], shards) + _messages("pairs", block, tok.pair_keys, [tok.pairs_n], shards)

    def sent(block: int, own: Owned, m: Model, last: bool) -> list[tuple]:
        """What a block sends after seating its pairs; the state is for itself."""
        tables = m.tables()
        sums = np.stack([x + own.base[k % 2] for k, x in enumerate(m.sums(tables))]).astype("<u4")
        own.tables = tables.sum(axis=0).astype(np.int64)
        out = [("round", s, block, None, _pack(x)) for s, x in enumerate(np.split(sums, np.cumsum(own.words)[:-1], axis=1)) if x.size]
        if not last:
            return [*out, ("state", block, block, None, own.pack())]
        return out + [("tables", s, block, None, _pack(x.astype("<u4")))
                      for s, x in enumerate(np.split(own.tables, np.cumsum(own.pairs)[:-1])) if len(x)]

    def first_round(totals: dict, last: bool):
        def send(block, ids, body, lens, got) -> list[tuple]:
            tok = Tokens(ids, body, lens)
            c, = _read(got["words"], tok.keys, 1, shards)
            own, order = Owned.of(tok, *_read(got["pairs"], tok.pair_keys, 2, shards, _key_bytes("pairs")), shards)
            return sent(block, own, Model(own, totals, seed, c[order], own.c), last)
        return send

    def next_round(totals: dict, last: bool):
        def send(block, got) -> list[tuple]:
            own = Owned.unpack(got["state"][0]["values"], shards)
            by = {r["shard"]: r["values"] for r in got["round"]}
            seen = np.concatenate([_values(by[s], 3 * SAMPLES, n) for s, n in enumerate(own.words) if n], axis=1).astype(np.int64)
            return sent(block, own, Model(own, totals, seed, None, own.c, seen, own.tables), last)
        return send

    counts = shard_by_shard(ask(parts.select("block", "ids", "body", "lens", F.lit(None).cast("array<struct<kind:string>>")), counted), count, "lm-counts")
    totals = dict(zip(("n", "v"), stats(counts, "words")), rounds=0)
    kept = [counts.filter(F.col("kind") == f"{a} kept").select(
        F.lit(b).alias("kind"), "shard", "block", F.col("values").alias("keys"), F.lit(None).cast("binary").alias("values"))
        for a, b in (("words", "round"), ("pairs", "tables"))]
    for r in range(1, rounds + 1):
        now, last = dict(totals), r == rounds
        messages = ask(with_texts(for_blocks(counts)), first_round(now, last)) if r == 1 else ask(for_blocks(got), next_round(now, last))
        got = shard_by_shard(functools.reduce(DataFrame.unionByName, kept[:1 + last], messages), answer(now), "lm-round")
        s = stats(got, "round")
        totals |= {"customers": s[::2], "tables": s[1::2], "rounds": r}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, body, lens, got = (c[i].as_py() for c in batch.columns[1:])
                tok, got = Tokens(ids, body, lens), of_kinds(got)
                c, = _read(got["words"], tok.keys, 1, shards)
                cp, _ = _read(got["pairs"], tok.pair_keys, 2, shards, _key_bytes("pairs"))
                tables, = _read(got.get("tables"), tok.pair_keys, 1, shards, _key_bytes("pairs"), cp > 1)
                m = Model(tok, totals, seed, c, cp, _read(got["round"], tok.keys, 3 * SAMPLES, shards), tables[cp > 1])
                by_pair, by_word = m.log10()
                add = lambda x: np.add.reduceat(x, tok.first[:-1])
                scores = add(by_pair[tok.of])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i].values, pa.array(tok.held), pa.array(tok.n.astype(np.int64)),
                    pa.array(add((m.c > 0)[tok.word].astype(np.int64))), pa.array(np.full(len(ids), totals["n"], dtype=np.int64)),
                    pa.array(add(by_word[tok.word])), pa.array(scores), pa.array(10.0 ** (-scores / tok.n))],
                    names=["d", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = parts.schema["d"].dataType.elementType.simpleString()
    out = parts.join(for_blocks(counts, got), "block", "left").select("d", "ids", "body", "lens", "replies").mapInArrow(
        lean(score), f"d {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double, perplexity double")
    return out.select("d.*", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def root_tables(customers: np.ndarray, keys: np.ndarray, totals: dict) -> np.ndarray:
    """Tables of the root restaurant, one shard of its dishes, given the tables of all shards in the
    round before. In the first round the other shards' tables are taken as many per dish as this
    shard's (keys are hashed, so shards are alike)."""
    before = totals.get("tables")
    t = np.minimum(customers, 1).astype(float)
    base, many = 1 / (totals["v"] + 1), np.flatnonzero(customers > 1)
    for k in range(3):
        others = (np.mean(before) if before else t.sum() / max(1, (customers > 0).sum()) * totals["v"]) - 1
        weight = np.full(len(many), (ROOT_STRENGTH + ROOT_DISCOUNT * max(0.0, others)) * base)
        t[many] = gibbs(customers[many], weight, np.full(len(many), ROOT_DISCOUNT * base), ROOT_DISCOUNT,
                        keys[many] + U(k * STEP % WRAP), 2)[-1]
    return t.astype(np.int64)
