"""Substring deduplication by seed and extend (operator 5).

Seeds are winnowed anchors: of the k-word grams in every 20-word window the one with the smallest
hash is the window's anchor, so windows with equal words have equal anchors at equal places, and
an anchor that occurs once proves that none of its windows repeats. Around each anchor that occurs
again every window whose anchor it is is looked up by its hash, and counts as a repeat if its words
also start earlier (in a smaller doc_id, or earlier in the same document). This lookup replaces the
join of occurrences and the extension of each pair to both sides: a hot passage has too many pairs,
and the union of its repeated windows is the same spans. The union of the repeats is a set of maximal
repeated spans, each at least 20 words long, and their words are removed; the first occurrence
stays. Windows are judged on the input, not on what is left of it.

Plan. Blocks of documents send hashes to shards chosen by the hash, and shards answer with one bit
per hash: first the distinct anchors (does it occur again?), then, around repeated anchors only,
the first place of each distinct window (is it the first of all?). The blocks are stored in buckets by
block number, so texts are read again, never shuffled; messages stay in Arrow. Every block sends a hash once,
however often it holds it, so a passage that a third of all documents share costs one entry per
block; no pairs of occurrences are formed. The number of shards grows with the text. Hashes are
64-bit for anchors, where a collision only costs an extra check, and 128-bit for windows.

A null text counts as empty and has no words. A null doc_id is ordered after all others. Rows with
equal doc_id are ordered by their place in the input; the later of two repeated rows loses its
words to the earlier. Texts of any length are whole. An empty table gives an empty result; of the
other columns only those in ``carry`` are kept; one that is named like a result column is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_words, blocks, gram_hash, lean, lean_group, mix, open_block, refuse_clash, stored, total_size, word_hashes

WINDOW = 20
GRAM = 10                      # words of an anchor
SHARD_BYTES = 8 << 20         # text whose hashes meet in one shard, on average
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LAST = np.iinfo(np.int64).max
RUN = re.compile(rb"[^\x20\x09-\x0D]+")


class Windows:
    """The windows of one block: where they start, their anchors and their hashes."""

    def __init__(self, body: bytes, lens: bytes, window: int, gram: int):
        self.texts = open_block(body, lens)
        ids, words, self.n_words = block_words(self.texts)
        self.window = window
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        h1, h2 = (h[ids] for h in word_hashes(words))
        grams = gram_hash(h1, gram, BASES[0])
        full = np.repeat(self.first[1:], self.n_words) - np.arange(len(ids)) >= window
        self.start = np.flatnonzero(full)
        order = mix(grams)
        at, low = self.start.copy(), order[self.start] if len(self.start) else order[:0]
        for j in range(1, window - gram + 1):
            here = order[self.start + j]
            better = here <= low
            low = np.where(better, here, low)
            at[better] = self.start[better] + j
        self.anchor_at = at
        self.anchors, self.anchor_of = np.unique(grams[at], return_inverse=True) if len(at) else (grams[:0], at)
        places = np.unique(at)
        again = np.unique(grams[places], return_counts=True)[1] if len(at) else np.empty(0, dtype=np.int64)
        self.twice = again > 1                      # anchors at two places of this block
        self.h = h1, h2

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def near(self, repeated: np.ndarray) -> None:
        """Keep the windows whose anchor is repeated, and group them by their words."""
        self.start = self.start[repeated[self.anchor_of]]
        self.k1 = gram_hash(self.h[0], self.window, BASES[0])[self.start]
        self.k2 = gram_hash(self.h[1], self.window, BASES[1])[self.start]


def _shards(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys), places in ascending order."""
    shard = (mix(keys) % np.uint64(n)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(shard[part[0]]), part


def _answers(keys: np.ndarray, n: int, replies) -> np.ndarray:
    """The bits of all shards, put back in the order of ``keys``."""
    out = np.zeros(len(keys), dtype=bool)
    got = {r["shard"]: r["bits"] for r in (replies if replies is not None else [])}
    for shard, part in _shards(keys, n):
        out[part] = np.unpackbits(np.frombuffer(got[shard], dtype=np.uint8), count=len(part)).astype(bool)
    return out


def _sent(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Messages: two numbers (shard, block), then bytes."""
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(zip(*rows))], names=names)


def _reply(asked: pa.Table, bits: np.ndarray, n: list[int]) -> pa.Table:
    """A shard's answers: the bits of each message's ``n`` keys."""
    own = pa.array([np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(n)[:-1])], pa.binary())
    return pa.table({"block": asked["block"], "shard": asked["shard"], "bits": own})


def _long(column: list) -> np.ndarray:
    return np.array([LAST if v is None else v for v in column], dtype=np.int64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ("doc_id",),
                   want: tuple[str, ...] = ("kept", "text", "spans")) -> DataFrame:
    """``carry`` columns (doc_id among them), ``n_words``, ``n_removed`` and, as wanted, ``kept``
    (kept words joined by a space), ``text`` (the text without the removed spans) and ``spans``
    (first word and number of words of each removed span)."""
    carry = list(dict.fromkeys(["doc_id", *carry]))
    refuse_clash(carry, ("n_words", "n_removed", *want))
    parts = blocks(docs.select(*carry, *[c for c in ["text"] if c not in carry]), carry, "repeat-blocks", bucketed=True)
    shards = max(1, total_size(parts) // SHARD_BYTES)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, lens in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                w = Windows(body, lens, window, gram)
                rows = [(s, block, w.anchors[p].tobytes(), np.packbits(w.twice[p]).tobytes())
                        for s, p in _shards(w.anchors, shards)]
                if rows:
                    yield _sent(rows, ["shard", "block", "keys", "twice"])

    def repeated(b: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, dtype=np.uint64) for k in b["keys"].to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(k))
                                for t, k in zip(b["twice"].to_pylist(), keys)])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        again = np.bincount(at, weights=1 + twice)[at] > 1
        return _reply(b, again, [len(k) for k in keys])

    def firsts(w: Windows, ids: np.ndarray):
        """The block's first window of each distinct word sequence, in the order of the documents."""
        doc = w.doc(w.start)
        order = np.lexsort((w.start, doc, ids[doc], w.k2, w.k1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (w.k1[order][1:] != w.k1[order][:-1]) | (w.k2[order][1:] != w.k2[order][:-1])
        return np.sort(order[new]), doc

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, body, lens, r in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                w = Windows(body, lens, window, gram)
                w.near(_answers(w.anchors, shards, r))
                ids = _long(ids)
                one, doc = firsts(w, ids)
                rows = [(s, block, w.k1[p].tobytes(), w.k2[p].tobytes(), ids[doc[p]].tobytes(),
                         doc[p].astype(np.int32).tobytes(), w.start[p].astype(np.int32).tobytes())
                        for s, q in _shards(w.k1[one], shards) for p in [one[q]]]
                if rows:
                    yield _sent(rows, ["shard", "block", "k1", "k2", "id", "doc", "start"])

    def earliest(b: pa.Table) -> pa.Table:
        col = {c: [np.frombuffer(x, dtype=t) for x in b[c].to_pylist()] for c, t in
               (("k1", "u8"), ("k2", "u8"), ("id", "i8"), ("doc", "i4"), ("start", "i4"))}
        n = [len(x) for x in col["k1"]]
        k1, k2, ids, doc, start = (np.concatenate(col[c]) for c in ("k1", "k2", "id", "doc", "start"))
        block = np.repeat(b["block"].to_numpy(), n)
        order = np.lexsort((start, doc, block, ids, k2, k1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        first = np.zeros(len(order), dtype=bool)
        first[order[new]] = True
        return _reply(b, first, n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, body, lens, r1, r2 = (batch.column(c)[i] for c in range(5))
                w = Windows(body.as_py(), lens.as_py(), window, gram)
                w.near(_answers(w.anchors, shards, r1.as_py()))
                docs_ = d.values
                ids = _long(docs_.field("doc_id").to_pylist())
                one, _ = firsts(w, ids)
                stays = np.zeros(len(w.start), dtype=bool)
                stays[one] = _answers(w.k1[one], shards, r2.as_py())
                edge = np.zeros(int(w.first[-1]) + 1, dtype=np.int64)
                np.add.at(edge, w.start[~stays], 1)
                np.add.at(edge, w.start[~stays] + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                texts = w.texts.cast(pa.large_binary())
                for j in range(0, len(docs_), 200):
                    rows = [_rest(t, gone[w.first[k]:w.first[k + 1]], want)
                            for k, t in enumerate(texts.slice(j, 200).to_pylist(), j)]
                    cols = dict(zip(("n_words", "n_removed", "kept", "text", "spans"), zip(*rows)))
                    yield pa.RecordBatch.from_arrays(
                        [docs_.slice(j, 200), *[pa.array(cols[c], t) for c, t in out_types]],
                        names=["d", *[c for c, _ in out_types]])

    out_types = [("n_words", pa.int64()), ("n_removed", pa.int64())] + [(c, t) for c, t in (
        ("kept", pa.string()), ("text", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))) if c in want]
    sql = {"n_words": "long", "n_removed": "long", "kept": "string", "text": "string",
           "spans": "array<struct<start: long, length: long>>"}
    reply = "block long, shard long, bits binary"

    def collected(messages: DataFrame, schema: str, fn, name: str) -> DataFrame:
        answers = messages.groupBy("shard").applyInArrow(lean_group(fn), schema)
        return stored(answers.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(name)), f"repeat-{name}")

    asked = parts.select("block", "body", "lens").mapInArrow(lean(ask_anchors), "shard long, block long, keys binary, twice binary")
    r1 = collected(asked, reply, repeated, "anchors")
    asked = (parts.join(r1, "block", "left")
             .select("block", F.col("d.doc_id").cast("array<bigint>").alias("ids"), "body", "lens", "anchors")
             .mapInArrow(lean(ask_windows), "shard long, block long, k1 binary, k2 binary, id binary, doc binary, start binary"))
    r2 = collected(asked, reply, earliest, "firsts")
    kind = parts.schema["d"].dataType.elementType.simpleString()
    out = (parts.join(r1, "block", "left").join(r2, "block", "left").select("d", "body", "lens", "anchors", "firsts")
           .mapInArrow(lean(cut), f"d {kind}, " + ", ".join(f"{c} {sql[c]}" for c, _ in out_types)))
    return out.select("d.*", *[c for c, _ in out_types])


def _rest(raw: bytes, gone: np.ndarray, want) -> tuple:
    """(words, removed words, kept words, cleaned text, removed spans) of one text."""
    n, removed = len(gone), int(gone.sum())
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2])] if "spans" in want else None
    kept = text = None
    if "kept" in want:
        words = raw.split()
        kept = b" ".join(words if not removed else [w for w, g in zip(words, gone) if not g]).decode()
    if "text" in want and not removed:
        text = raw.decode()
    elif "text" in want:
        out, end, last = [], 0, False
        for m, g in zip(RUN.finditer(raw), gone):
            if not g:
                gap = raw[end:m.start()]
                if last:                          # a span was cut out: keep the kind of the gap
                    gap = b"" if not out else b"\n" if b"\n" in gap else b" "
                out += [gap, m.group()]
                end = m.end()
            last = bool(g)
        text = b"".join(out).decode()
    return n, removed, kept, text, spans
