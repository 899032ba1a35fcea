"""Ranked lexical search with a document FP-tree (operator 12).

Items are short texts; for each, the documents of highest score are found among all documents. Terms are
runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. A term's weight falls with
the documents that hold it, a document's ``m`` grows with its length (``weight``, ``score_parts``).

Each document is reduced to its vector restricted to the terms of the items: (term, tf), ordered by the
terms' document frequency, most frequent first. A run of documents (a shard, bounded in documents and
entries) becomes a trie of these vectors: documents whose vectors begin alike share a path, copies share
all of it. A node keeps, for each term below it, the largest tf, and the smallest m and document id. That
bounds the score of every document below it, since a score rises with tf and falls with m. An item's
search goes depth first into the child of highest bound and leaves out subtrees whose bound cannot enter
the item's best ``k``; at the leaves the documents' scores are exact. Nothing is lost: a subtree is left
out only if its bound is below the k-th score, or equal to it with larger ids only.

Plan: documents are read once and leave restricted vectors in the shared folder (one map stage); document
frequencies are summed by term; a second map stage builds shards and searches them, each task passing its
best scores on from shard to shard. A task returns at most k rows an item; these are ranked in two levels.
Items are taken in chunks of bounded count and size, each with a pass of its own, so that the terms and
items that a task holds are bounded however many items there are.

A null or empty text has no terms: such a document is never found, such an item finds none. Repeated rows
of documents are ranked each; repeated items come out each. A null doc_id counts as the largest. Equal
scores go by ascending doc_id. Empty tables give an empty result. Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import block_words, lean, slices, stored

ITEMS, ITEM_BYTES = 2000, 4 << 20          # items of one pass, and their texts
SHARD_DOCS, SHARD_ENTRIES = 20_000, 2_000_000
LEAF = 48                                  # documents of a leaf
SALT = 64

# One byte to one byte: separators to a space, A-Z lower-cased, everything else as it is.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_parts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each term adds to a score; ``m`` by row."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None]))


def _scan(vocabulary: list[bytes]):
    """Documents to blocks of restricted vectors, with the block's counts."""
    known = pa.array([t.decode() for t in vocabulary], pa.large_string())
    width = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(t or b"").translate(TERM_BYTES) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
                texts = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(b"".join(raw)))
                idx, distinct, sizes = block_words(texts)
                code = pc.fill_null(pc.index_in(distinct.cast(pa.large_string()), value_set=known), -1).to_numpy()[idx]
                doc = np.repeat(np.arange(len(raw)), sizes)
                cells, tf = np.unique((doc * width + code)[code >= 0], return_counts=True)
                held = np.bincount(cells // width, minlength=len(raw))
                has = held > 0
                term, df = np.unique(cells % width, return_counts=True)
                body = pack((cells % width).astype(np.int32).tobytes() + tf.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([
                    _one_list(part.column(0).filter(pa.array(has))), _one_list(pa.array(sizes[has], pa.int64())),
                    _one_list(pa.array(held[has], pa.int64())), pa.array([body], pa.binary()),
                    pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64()),
                    _one_list(pa.array(term, pa.int32())), _one_list(pa.array(df, pa.int64()))],
                    names=["ids", "n", "held", "body", "docs", "total", "term", "df"])
    return run


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Tree:
    """The trie of one shard. Documents are kept in the order of their vectors, so that a node is a run
    of documents; ``cells`` are node * width + term in order, ``most`` the largest tf of each."""

    def __init__(self, ids: list, m: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray, width: int):
        n, self.width = len(ids), width
        at = np.concatenate([[0], np.cumsum(held)])
        paths = [term[a:b].astype(">u4").tobytes() for a, b in zip(at[:-1], at[1:])]
        order = np.array(sorted(range(n), key=paths.__getitem__), dtype=np.int64)
        take = np.concatenate([np.arange(at[i], at[i + 1]) for i in order]) if n else np.zeros(0, dtype=np.int64)
        self.m, self.keys = m[order], [(ids[i] is None, ids[i]) for i in order]
        doc = np.repeat(np.arange(n), held[order])
        self.doc_cells, self.doc_tf = doc * width + term[take], tf[take]
        shared = np.zeros(n, dtype=np.int64)             # terms that a path shares with the one before it
        for i in range(1, n):
            a, b = paths[order[i - 1]], paths[order[i]]
            shared[i] = len(a) // 4 if a == b else _common(a, b) // 4
        self._grow(shared)
        self._bound(doc)

    def _grow(self, shared: np.ndarray):
        """Nodes from the root down: runs of documents, and each node's children (a run of nodes)."""
        self.start, self.end, self.parent, self.kids = [0], [len(shared)], [-1], {}
        inner = [0]
        for node in inner:
            first = len(self.start)
            for a, b, leaf in self._children(shared, self.start[node], self.end[node]):
                if not leaf:
                    inner.append(len(self.start))
                self.start.append(a)
                self.end.append(b)
                self.parent.append(node)
            self.kids[node] = np.arange(first, len(self.start))

    def _children(self, shared: np.ndarray, a: int, b: int) -> list[tuple[int, int, bool]]:
        """The branches below a node; a branch with most of the documents gives its own branches (so
        that the tree stays shallow), small branches side by side become one leaf."""
        size, todo, runs = b - a, [(a, b)], []
        while todo:
            s, e = todo.pop()
            if e - s > max(LEAF, size * 3 // 4) or (s, e) == (a, b):
                inside = shared[s + 1:e]
                cuts = s + 1 + np.flatnonzero(inside == inside.min()) if len(inside) else []
                bounds = [s, *cuts, e]
                todo.extend(reversed(list(zip(bounds[:-1], bounds[1:]))) if len(cuts) else [])
                if not len(cuts):
                    runs.append((s, e))
            else:
                runs.append((s, e))
        out: list[tuple[int, int, bool]] = []
        for s, e in runs:
            if e - s > LEAF:
                out.append((int(s), int(e), False))
            elif out and out[-1][2] and e - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], int(e), True)
            else:
                out.append((int(s), int(e), True))
        return out

    def _bound(self, doc: np.ndarray):
        """Largest tf of each term, smallest m and smallest id below each node."""
        nodes = len(self.start)
        self.least_m = np.array([self.m[a:b].min() if b > a else 0 for a, b in zip(self.start, self.end)])
        self.least_key = [min(self.keys[a:b], key=_known) if b > a else None for a, b in zip(self.start, self.end)]
        leaves = [i for i in range(1, nodes) if i not in self.kids]
        at = np.full(len(self.m), 0, dtype=np.int64)
        for i in leaves:
            at[self.start[i]:self.end[i]] = i
        depth = np.zeros(nodes, dtype=np.int64)
        for i in range(1, nodes):
            depth[i] = depth[self.parent[i]] + 1
        cells, tf = _largest(at[doc] * self.width + self.doc_cells % self.width, self.doc_tf)
        parent = np.array(self.parent)
        done_c, done_t = [], []
        for level in range(int(depth.max()), 0, -1):     # a level's nodes are complete once those below have passed theirs up
            here = depth[cells // self.width] == level
            c, t = _largest(cells[here], tf[here])
            done_c.append(c)
            done_t.append(t)
            cells = np.concatenate([cells[~here], parent[c // self.width] * self.width + c % self.width])
            tf = np.concatenate([tf[~here], t])
        self.cells, self.most = np.concatenate([*done_c, [0]])[:-1].astype(np.int64), np.concatenate([*done_t, [0]])[:-1]
        order = np.argsort(self.cells, kind="stable")
        self.cells, self.most = self.cells[order], self.most[order]

    def search(self, terms: np.ndarray, w: np.ndarray, best: list, k: int):
        """Enter the documents of this shard into ``best``: at most k of (-score, no id, id), in order."""
        stack = [(None, 0)]
        while stack:
            bound, node = stack.pop()
            if bound is not None and self._hopeless(bound, node, best, k):
                continue
            kids = self.kids.get(node)
            if kids is None:
                self._leaf(node, terms, w, best, k)
            elif len(kids):
                tf = _find(self.cells, self.most, kids[:, None] * self.width + terms)
                bounds = score_parts(w, tf, self.least_m[kids]).sum(axis=1)
                ahead = np.argsort(bounds, kind="stable")       # the highest bound is taken first
                stack.extend((int(bounds[i]), int(kids[i])) for i in ahead if bounds[i] > 0)

    def _hopeless(self, bound: int, node: int, best: list, k: int) -> bool:
        return len(best) == k and (bound < -best[-1][0] or bound == -best[-1][0]
                                   and _known(self.least_key[node]) >= _known(best[-1][1]))

    def _leaf(self, node: int, terms: np.ndarray, w: np.ndarray, best: list, k: int):
        docs = np.arange(self.start[node], self.end[node])
        scores = score_parts(w, _find(self.doc_cells, self.doc_tf, docs[:, None] * self.width + terms), self.m[docs]).sum(axis=1)
        floor = max(1, -best[-1][0]) if len(best) == k else 1
        for i in np.flatnonzero(scores >= floor):
            insort(best, (-int(scores[i]), self.keys[docs[i]]), key=lambda x: (x[0], _known(x[1])))
            del best[k:]


def _known(key: tuple):
    """A document's key as something that compares: null ids last."""
    return (True,) if key[0] else key


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a, dtype=">u4", count=n // 4) != np.frombuffer(b, dtype=">u4", count=n // 4))
    return 4 * int(apart[0]) if len(apart) else n


def _largest(cells: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the largest tf of each."""
    if not len(cells):
        return cells, tf
    order = np.argsort(cells, kind="stable")
    cells, tf = cells[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.maximum.reduceat(tf, first)


def _find(cells: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted cells; 0 where there is none."""
    if not len(cells):
        return np.zeros(wanted.shape, dtype=np.int64)
    at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    return np.where(cells[at] == wanted, values[at], 0)


def _search(queries: list[list[int]], item_ids: pa.Array, weights: np.ndarray, rank: np.ndarray, n_docs: int, total: int, k: int):
    """Blocks of vectors to each item's best documents of the task."""
    width = max(1, len(weights))
    by_rank = np.empty(width, dtype=np.int64)
    by_rank[rank] = weights if len(weights) else 0
    wanted = [np.sort(rank[q]) if q else np.zeros(0, dtype=np.int64) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        best: list[list] = [[] for _ in queries]
        ids, m, held, terms, tfs = [], [], [], [], []
        kind, docs, entries = None, 0, 0

        def close():
            nonlocal ids, m, held, terms, tfs, docs, entries
            tree = Tree(ids, np.concatenate(m), np.concatenate(held), np.concatenate(terms), np.concatenate(tfs), width)
            for q, b in zip(wanted, best):
                if len(q):
                    tree.search(q, by_rank[q], b, k)
            ids, m, held, terms, tfs, docs, entries = [], [], [], [], [], 0, 0

        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for i in range(batch.num_rows):
                n, h = (np.array(batch.column(c)[i].values) for c in (1, 2))
                if not len(h):
                    continue
                flat = np.frombuffer(unpack(batch.column(3)[i].as_py()), dtype=np.int32).astype(np.int64)
                term, tf = rank[flat[:len(flat) // 2]], flat[len(flat) // 2:]
                order = np.argsort(np.repeat(np.arange(len(h)), h) * width + term, kind="stable")
                ids.extend(batch.column(0)[i].as_py())
                m.append(50 + (50 * n * n_docs) // total)
                held.append(h)
                terms.append(term[order])
                tfs.append(tf[order])
                docs, entries = docs + len(h), entries + len(term)
                if docs >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                    close()
        if docs:
            close()
        found = [(i, key[1], -s) for i, b in enumerate(best) for s, key in b]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array([f[0] for f in found], pa.int32()), item_ids.take(pa.array([f[0] for f in found])),
                pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.int64())],
                names=["item", "item_id", "doc_id", "score"])
    return run


def _chunks(items: DataFrame) -> Iterator[list[Row]]:
    """Items in chunks of bounded count and size; the driver holds one at a time."""
    chunk, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        chunk.append(r)
        size += len(r.text or "")
        if len(chunk) >= ITEMS or size >= ITEM_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _search_chunk(docs: DataFrame, chunk: list[Row], item_kind: str, k: int) -> DataFrame | None:
    """Each item's best documents by task, as a stored table; None if nothing can be found."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    per_item = [set(terms_of(r.text)) for r in chunk]
    vocabulary = sorted(set().union(*per_item))
    if not vocabulary:
        return None
    code = {t: i for i, t in enumerate(vocabulary)}
    vectors = stored(docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        lean(_scan(vocabulary)), f"ids array<{kind}>, n array<long>, held array<long>, body binary, docs long, "
        "total long, term array<int>, df array<long>"), "fptree-vectors")
    n_docs, total = vectors.agg(F.sum("docs"), F.sum("total")).first()
    if not total:
        return None
    df = np.zeros(len(vocabulary), dtype=np.int64)
    counts = vectors.select(F.inline(F.arrays_zip("term", "df"))).groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.collect():                            # at most the terms of a chunk of items
        df[r.term] = r.df
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weights = np.array([weight(n_docs, int(d)) for d in df], dtype=np.int64)
    queries = [[code[t] for t in sorted(q) if df[code[t]]] for q in per_item]
    ids = spark.createDataFrame([(r.item_id,) for r in chunk], f"item_id {item_kind}").toArrow().column(0).combine_chunks()
    run = _search(queries, ids, weights, rank, n_docs, total, k)
    return stored(vectors.select("ids", "n", "held", "body").mapInArrow(
        lean(run), f"item int, item_id {item_kind}, doc_id {kind}, score long"), "fptree-found")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: each item's k documents of highest score."""
    item_kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"chunk int, item int, item_id {item_kind}, doc_id {doc_kind}, score long")
    for i, chunk in enumerate(_chunks(items)):
        part = _search_chunk(docs, chunk, item_kind, k)
        if part is not None:
            found = found.unionByName(part.withColumn("chunk", F.lit(i)))
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "item", "salt").orderBy(*best))).filter(F.col("r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "item").orderBy(*best)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
