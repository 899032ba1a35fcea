"""Byte-level BPE encoding and decoding (operator 9).

Encoding runs over blocks of documents. A first map step splits each text with the tokenizer's
pattern and numbers the block's distinct words; words that are tokens themselves need no merge.
The others travel as strings with one character per byte id. A second map step merges all words of
a block at once, in rounds: each round looks up the rank of the adjacent pairs that are new and merges
the leftmost pair of the lowest rank in every word that has one. It then puts the words' ids back in
document order; decoding concatenates the binary pieces of the ids. A word of many bytes takes its
pairs from a heap instead, so that its cost does not grow with the square of its length.

Every block is independent: one stage, no shuffle, and a task holds one block (bounded text and
bounded distinct words; a longer single document is a block of its own). A null text counts as
empty and has no ids. Repeated rows are encoded alike; a null doc_id stays null; further columns
are not carried along.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

NONE = 1 << 30            # rank of a pair that does not merge
LONG_WORD = 256           # bytes of a word that is merged by itself
BLOCK_CHARS = 8 << 20     # text of one block
BLOCK_WORDS = 130_000     # distinct words of one block
BASE = 0x10000            # id i is the character BASE + i, four bytes in UTF-8


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Every split of a token into two tokens: the pair, as one number, and the rank of the token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()) + 1
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[a * self.width + b] = rank
        self.pairs = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([found[p] for p in self.pairs.tolist()], dtype=np.int64)

    @functools.cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), self.ranks.tolist()))

    def rank(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pairs that begin at the places ``at``."""
        out = np.full(len(at), NONE, dtype=np.int64)
        inside = np.flatnonzero(at + 1 < len(ids))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        pair = ids[at[inside]] * self.width + ids[at[inside] + 1]
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[place] == pair if len(self.pairs) else np.zeros(len(pair), dtype=bool)
        out[inside[known]] = self.ranks[place[known]]
        return out


def merge_words(ids: np.ndarray, counts: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``counts`` byte ids each, one after another -> their token ids in the same form."""
    ids, word = ids.astype(np.int64), np.repeat(np.arange(len(counts)), counts)
    ended = []
    large = np.flatnonzero(counts >= LONG_WORD)
    if len(large):
        first = np.concatenate([[0], np.cumsum(counts)])
        for w in large.tolist():
            alone = merge_long(ids[first[w]:first[w + 1]], merges)
            ended.append((alone, np.full(len(alone), w)))
        rest = np.repeat(counts < LONG_WORD, counts)
        ids, word = ids[rest], word[rest]
    rank = merges.rank(ids, word, np.arange(len(ids)))
    while len(ids):
        new = np.ones(len(ids), dtype=bool)
        new[1:] = word[1:] != word[:-1]
        start = np.flatnonzero(new)
        low = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), start)     # rank and place, as one number
        more = low < NONE << 32
        stays = np.repeat(more, np.diff(np.append(start, len(ids))))
        ended.append((ids[~stays], word[~stays]))
        at = low[more] & ((1 << 32) - 1)
        ids[at] = rank[at]                        # a token's id is its rank
        stays[at + 1] = False
        at = np.cumsum(stays)[at] - 1
        ids, word, rank = ids[stays], word[stays], rank[stays]
        fresh = np.concatenate([at, at[at > 0] - 1])
        rank[fresh] = merges.rank(ids, word, fresh)
    if not ended:
        return ids, counts
    ids, word = (np.concatenate(x) for x in zip(*ended))
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(counts))


def merge_long(ids: np.ndarray, merges: Merges) -> np.ndarray:
    """One word: a heap of (rank, place) over a linked list of what is left of it."""
    n = len(ids)
    rank = merges.rank(ids, np.zeros(n, dtype=np.int64), np.arange(n))
    ids, before, after = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    now = rank.tolist()                           # the rank of the pair at each place; an older entry of the heap is void
    heap = [(r, i) for i, r in enumerate(now) if r < NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if now[i] != r:
            continue
        j = after[i]
        ids[i], now[j], after[i] = r, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0:
                m = after[k]
                now[k] = merges.table.get(ids[k] * merges.width + ids[m], NONE) if m < n else NONE
                if now[k] < NONE:
                    heapq.heappush(heap, (now[k], k))
    return np.array([x for x, r in zip(ids, now) if r >= 0], dtype=np.int64)


def to_chars(ids: np.ndarray, counts) -> pa.Array:
    """Words of ``counts`` ids each as strings, written straight into an Arrow buffer."""
    c = ids.astype(np.uint32) + BASE
    utf8 = np.stack([0xF0 | c >> 18, 0x80 | c >> 12 & 0x3F, 0x80 | c >> 6 & 0x3F, 0x80 | c & 0x3F], axis=1).astype(np.uint8)
    offsets = (4 * np.concatenate([[0], np.cumsum(counts)])).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(utf8)))


def from_chars(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each has."""
    raw = words.cast(pa.binary())
    counts = pc.binary_length(raw).to_numpy(zero_copy_only=False) // 4
    utf8 = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).reshape(-1, 4).astype(np.uint32) & 0x3F
    ids = ((utf8[:, 0] & 7) << 18 | utf8[:, 1] << 12 | utf8[:, 2] << 6 | utf8[:, 3]) - BASE
    return ids, counts


def _ragged(values: np.ndarray, offsets: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Concatenation of values[offsets[i]:offsets[i + 1]] for i in idx."""
    n = offsets[idx + 1] - offsets[idx]
    return values[np.arange(int(n.sum())) + np.repeat(offsets[idx] - (np.cumsum(n) - n), n)]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (bytes) of every row."""
    ranks = load_ranks(ranks_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    merges = Merges(ranks)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks: the documents, their word numbers, and the distinct words left to merge."""
        import regex
        find = regex.compile(pattern).findall
        seen: dict[str, int] = {}
        docs_, idx, held, own = [], [], 0, None

        def close():
            nonlocal seen, docs_, idx, held
            known = np.full(len(seen), -1, dtype=np.int32)
            left = []
            for i, w in enumerate(seen):
                raw = w.encode()
                r = ranks.get(raw)
                if r is None:
                    left.append(raw)
                else:
                    known[i] = r
            flat = byte_ids[np.frombuffer(b"".join(left), dtype=np.uint8)]
            words = to_chars(flat, [len(w) for w in left])
            batch = pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(docs_)], pa.int32()), pa.array(docs_, own)),
                pa.array([[i.tobytes() for i in idx]], pa.list_(pa.binary())),
                pa.array([known.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), words),
            ], names=["docs", "idx", "known", "words"])
            seen, docs_, idx, held = {}, [], [], 0
            return batch

        for batch in batches:
            own = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t = t or ""
                    docs_.append(d)
                    idx.append(np.array([seen.setdefault(w, len(seen)) for w in find(t)], dtype=np.int32))
                    held += len(t)
                    if held >= BLOCK_CHARS or len(seen) >= BLOCK_WORDS:
                        yield close()
        if docs_:
            yield close()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            pieces[r] = token
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        raw_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        for batch in batches:
            own = batch.schema.field(0).type.value_type
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                known = np.frombuffer(row.column(2)[0].as_py(), dtype=np.int32)
                left = row.column(3)[0].values
                values, counts = merge_words(*from_chars(left), merges)
                lens = np.ones(len(known), dtype=np.int64)
                lens[known < 0] = counts
                at = np.concatenate([[0], np.cumsum(lens)])
                flat = np.empty(int(at[-1]), dtype="<u4")
                flat[at[:-1][known >= 0]] = known[known >= 0]
                flat[np.repeat(known < 0, lens)] = values
                ids_of, texts = row.column(0)[0].values, row.column(1)[0].values
                for j in range(0, len(ids_of), 200):
                    out = [_ragged(flat, at, np.frombuffer(x.as_py(), dtype=np.int32)) for x in texts[j:j + 200]]
                    yield pa.RecordBatch.from_arrays([
                        ids_of.slice(j, 200).cast(own),
                        pa.array([o.tobytes() for o in out], pa.binary()),
                        pa.array([_ragged(raw, raw_at, o).tobytes() for o in out], pa.binary()),
                    ], names=["doc_id", "ids", "decoded"])

    blocks = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lean(split), f"docs array<{kind}>, idx array<binary>, known binary, words array<string>")
    return blocks.mapInArrow(
        lean(join), f"doc_id {kind}, ids binary, decoded binary")
