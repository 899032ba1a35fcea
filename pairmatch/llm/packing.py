"""Lexical retrieval packing (operator 2).

Documents are encoded once and stored as ids. Document frequencies, the number of documents and
their mean length are counted over all of them. Each document is then routed by content: by the
heaviest of its terms (by corpus-wide BM25 weight) that enough documents hold to fill some windows,
then by its two heaviest terms of all, then by its row. Documents are dealt out by ranges of that
key, so those of a topic come together wherever they stood in the input, and a term (or a group of
copies) with more documents than fit is split by the further keys. In this order they are cut into
shards, bounded by documents and by tokens.

A shard holds a BM25 inverted index of its documents. Packing starts a sequence
with a seed document (an unused one, or the rest of the document that the sequence before cut),
asks the index for the seed's best-scoring unused neighbours and fills the window with them in that
order; the last one is cut where the window ends and its rest is the next seed. So every sequence
but a shard's last is full. The last one is cut into sequences whose lengths are powers of two,
which need no padding. Neighbours in another shard are not found.

No text is collected: one number per token id reaches the driver, and a shard is all that a task
holds. A very long document simply runs through many sequences. A query has all terms of the seed
(``query_terms``, if given: only that many, the heaviest); terms in more than half of all documents
weigh nothing. Ties go to the document routed first. A null text counts as empty (its only id is the end id);
repeated rows are packed once each, like any other row; a null doc_id stays null. Further columns
of the input are not carried along.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stored, word_hashes

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 1000          # documents of one index shard
SHARD_TOKENS = 4_000_000   # and tokens, so that a shard of long documents stays small
RUN = 8                    # shards of one task, as planned
ENOUGH = 8                 # windows that the documents of a routing term fill at least
QUERY = None               # terms of a query: all
FEW = 32                   # neighbours that are ranked first; a window seldom takes more
CACHE = 1_500_000          # distinct runs a task remembers (some 40 bytes each); beyond it starts anew

PLAIN = "^[!-&(-~]+$"       # printable ASCII, no apostrophe (the tokenizer keeps 's, 't and the like together)
CHANGE = "[a-z][^a-z]|[^a-z][a-z]|[0-9][^a-z]|[^a-z][0-9]"   # of lower-cased runs: more than one part
MARKED = r"^\pL+[.,]$"      # letters and a mark that often follows a word

SCHEMA = ("doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "`offset` long")


class Encoder:
    """Token ids of texts by a public tokenizer file.

    The tokenizer lower-cases, drops white space and never merges across it, nor between letters
    and marks. So texts are cut at spaces and line ends, and each distinct run is encoded once and
    then looked up. Runs of letters are encoded many at a time as one text: each is one word to the
    tokenizer, whose ids end at the one end-of-word id. Lower-case ASCII letters need none of its
    normalisation, so they go to its model directly. A run of several kinds of characters is put
    together from its parts."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True            # their strings in a text are ordinary text
        self.ascii = Tokenizer(self.tok.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.end = end_id
        self._reset()

    def _reset(self):
        self.runs = 0
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.offs = np.zeros(1 << 16, dtype=np.int64)    # offs[i]:offs[i + 1] are the ids of run i
        none = np.empty(0, dtype=np.uint64)              # hashes of the runs, by the first one, and their
        self.known = self.recent = (none, none, np.empty(0, dtype=np.int64))   # numbers; those learned last apart

    def _add(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keep the ids of new runs, those of run i up to ends[i]; the runs' numbers."""
        k, n, at = self.runs, len(ends), int(self.offs[self.runs])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while k + n + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs, np.empty_like(self.offs)])
        self.flat[at:at + len(ids)] = ids
        self.offs[k + 1:k + 1 + n] = at + ends
        self.runs += n
        return np.arange(k, k + n)

    def _gather(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs ``idx`` one after another, and where each run's ids start."""
        start, n = self.offs[idx], self.offs[idx + 1] - self.offs[idx]
        before = np.cumsum(n) - n
        return self.flat[np.arange(int(n.sum())) + np.repeat(start - before, n)], before

    def _letters(self, words: pa.Array, tok) -> np.ndarray:
        """The numbers of words of letters; -1 where the tokenizer sees more than one word."""
        out = [np.empty(0, dtype=np.int64)]
        for i in range(0, len(words), 2000):
            part = words.slice(i, 2000)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            got = tok.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            out.append(self._add(ids, ends) if len(ends) == len(part) else np.full(len(part), -1))
        return np.concatenate(out)

    def _learn(self, runs: pa.Array) -> np.ndarray:
        """The numbers of distinct runs that are not known yet."""
        out = np.full(len(runs), -1, dtype=np.int64)
        alpha, plain = _mask(pc.utf8_is_alpha(runs)), _mask(pc.string_is_ascii(runs))
        for ascii_, tok in ((True, self.ascii), (False, self.tok)):
            own = np.flatnonzero(alpha & (plain == ascii_))
            out[own] = self._letters(runs.take(pa.array(own)), tok)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            got = [e.ids for e in self.tok.encode_batch_fast(runs.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
            out[rest] = self._add(np.array([i for x in got for i in x], dtype=np.uint32), np.cumsum([len(x) for x in got]))
        return out

    def _parts(self, runs: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Which runs the tokenizer cuts in a known way, and their parts: ASCII ones without
        apostrophes into letters, single digits and other signs; others into letters and one mark."""
        cut = _mask(pc.match_substring_regex(runs, PLAIN)) & _mask(pc.match_substring_regex(runs, CHANGE))
        spaced = pc.replace_substring_regex(runs.filter(pa.array(cut)), "([a-z]+|[0-9]|[^a-z0-9]+)", r"\1 ")
        at = np.flatnonzero(~_mask(pc.string_is_ascii(runs)) & _mask(pc.match_substring_regex(runs, MARKED)))
        word = [unicodedata.normalize("NFC", r[:-1]).lower().isalpha() for r in runs.take(pa.array(at)).to_pylist()]
        at = at[np.array(word, dtype=bool)]
        both = np.concatenate([np.flatnonzero(cut), at])
        spaced = pa.concat_arrays([spaced, pc.replace_substring_regex(runs.take(pa.array(at)), "(.)$", r" \1")])
        cut[at] = True
        return cut, pc.split_pattern(pc.utf8_rtrim(spaced.take(pa.array(np.argsort(both))), " "), " ")

    def _find(self, runs: pa.Array) -> np.ndarray:
        """The numbers of distinct runs; unknown ones are learned. Runs are known by two 64-bit
        hashes, a fraction of the memory that the strings would take."""
        h1, h2 = word_hashes(runs)
        order = np.argsort(h1)                           # looked up in ascending order, which is faster
        runs, h1, h2 = runs.take(pa.array(order)), h1[order], h2[order]
        idx = _numbers(self.known, h1, h2)
        new = np.flatnonzero(idx < 0)
        idx[new] = _numbers(self.recent, h1[new], h2[new])
        new = np.flatnonzero(idx < 0)
        if len(new):
            text = runs.take(pa.array(new))
            cut, parts = self._parts(text)
            idx[new[~cut]] = self._learn(text.filter(pa.array(~cut)))
            self._keep(h1[new[~cut]], h2[new[~cut]], idx[new[~cut]])   # parts may be among them
            if cut.any():                                # put together from its parts
                each = parts.flatten().dictionary_encode()
                ids, before = self._gather(self._find(each.dictionary)[each.indices.to_numpy()])
                last = np.cumsum(pc.list_value_length(parts).to_numpy())
                idx[new[cut]] = self._add(ids, np.append(before, len(ids))[last])
                self._keep(h1[new[cut]], h2[new[cut]], idx[new[cut]])
        out = np.empty_like(idx)
        out[order] = idx
        return out

    def _keep(self, h1: np.ndarray, h2: np.ndarray, idx: np.ndarray):
        order = np.argsort(h1)                           # only the new ones are sorted
        self.recent = _merge(self.recent, (h1[order], h2[order], idx[order]))
        if len(self.recent[0]) > max(1 << 14, len(self.known[0]) // 8):
            self.known, self.recent = _merge(self.known, self.recent), tuple(x[:0] for x in self.recent)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's followed by the end id, and the
        bounds of the texts; a null text counts as empty."""
        low = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", " ")
        lists = pc.split_pattern(low, " ")
        runs = lists.flatten().dictionary_encode()
        ids, before = self._gather(self._find(runs.dictionary)[runs.indices.to_numpy()])
        ends = np.append(before, len(ids))[np.cumsum(pc.list_value_length(lists).to_numpy())]
        bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        return np.insert(ids, ends, np.uint32(self.end)), bounds

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids and the end id."""
        ids, bounds = self.encode_flat(texts)
        return np.split(ids.astype("<u4"), bounds[1:-1])

    def tidy(self):
        if self.runs > CACHE:
            self._reset()


def _merge(into: tuple, new: tuple) -> tuple:
    place = np.searchsorted(into[0], new[0])
    return tuple(np.insert(old, place, x) for old, x in zip(into, new))


def _numbers(known: tuple, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The numbers of runs by their hashes, -1 where they are not known."""
    if not len(known[0]):
        return np.full(len(h1), -1)
    pos = np.minimum(np.searchsorted(known[0], h1), len(known[0]) - 1)
    return np.where((known[0][pos] == h1) & (known[1][pos] == h2), known[2][pos], -1)


_SHARED: dict[tuple[str, int], Encoder] = {}


def shared_encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this Python worker: its tasks share the runs they learned (at most ``CACHE``
    and those of one batch)."""
    if (path, end_id) not in _SHARED:
        _SHARED.clear()
        _SHARED[path, end_id] = Encoder(path, end_id)
    return _SHARED[path, end_id]


def drop_encoder():
    """Later steps of the job do not need what this worker learned."""
    _SHARED.clear()


def _mask(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def distinct(ids: np.ndarray, bounds: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each document, ascending: (document, id, how often)."""
    n = len(bounds) - 1
    key = np.repeat(np.arange(n), np.diff(bounds)) * vocab + ids
    key = np.sort(key.astype(np.uint32 if n * vocab < 1 << 32 else np.uint64))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
    doc, term = np.divmod(key[at].astype(np.int64), vocab)
    return doc, term, np.diff(np.append(at, len(key)))


class Stats:
    """Document frequencies by token id, the number of documents and their mean length."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.df, self.n, self.mean = df, n, mean
        self.idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))

    def weights(self, term: np.ndarray, tf: np.ndarray, length, k1: float, b: float) -> np.ndarray:
        return self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.mean))

    def route(self, ids: np.ndarray, bounds: np.ndarray, enough: float, k1: float, b: float) -> np.ndarray:
        """What each document is routed by: the heaviest of its terms that at least ``enough``
        documents hold, then its two heaviest terms that another document holds (-1: none); of
        equal ones the smallest."""
        doc, term, tf = distinct(ids, bounds, len(self.df))
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))   # no document is without a term
        n = np.diff(np.append(first, len(doc)))
        w = self.weights(term, tf, np.diff(bounds)[doc], k1, b)
        df = self.df[term]

        def heaviest(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            most = np.maximum.reduceat(w, first)
            top = np.flatnonzero(w == np.repeat(most, n))
            at = top[np.append(True, doc[top][1:] != doc[top][:-1])]
            return at, np.where(most > 0, term[at], -1)

        _, wide = heaviest(np.where(df >= max(2, enough), w, 0))
        w = np.where(df > 1, w, 0)
        at, one = heaviest(w)
        w[at] = 0
        return np.stack([wide, one, heaviest(w)[1]])


class Bm25:
    """Inverted index of one shard over token ids; a document's terms are its distinct ids."""

    def __init__(self, docs: list[np.ndarray], vocab: int, k1: float, b: float, query_terms: int | None = None,
                 stats: Stats | None = None):
        n = len(docs)
        lens = np.array([len(d) for d in docs], dtype=float)
        doc, term, tf = distinct(np.concatenate(docs), np.append(0, np.cumsum(lens)).astype(np.int64), vocab)
        tf = tf.astype(float)
        here = np.bincount(term, minlength=vocab)
        stats = stats or Stats(here, n, lens.mean())
        w = stats.weights(term, tf, lens[doc], k1, b)
        # the query of each document: its terms that some other document of the shard holds
        use = np.flatnonzero((here[term] > 1) & (w > 0))
        term, doc, w = term[use], doc[use], w[use]
        qd, qt = doc, term
        if query_terms is not None:                      # the heaviest ones only
            order = np.lexsort((term, -w, doc))
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            qd, qt = doc[rank < query_terms], term[order][rank < query_terms]
        self.q_terms = qt.astype(np.int64)
        self.q_first = np.searchsorted(qd, np.arange(n + 1))
        order = np.argsort(term, kind="stable")          # by term, then by document
        self.p_doc, self.p_w = doc[order], w[order]
        self.p_first = np.searchsorted(term[order], np.arange(vocab + 1))
        self.n = self.held = n                           # documents, and those with postings

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> list[int]:
        """Unused documents that share a term of positive weight with ``seed``, best first; with
        ``most``, so many of the best (and those equal to the last of them), if there are more."""
        terms = self.q_terms[self.q_first[seed]:self.q_first[seed + 1]]
        if not len(terms):
            return []
        at = self.p_first[terms]
        n = self.p_first[terms + 1] - at
        ends = np.cumsum(n)
        own = np.arange(ends[-1]) + np.repeat(at - (ends - n), n)
        score = np.bincount(self.p_doc[own], weights=self.p_w[own], minlength=self.n)
        found = np.flatnonzero((score > 0) & unused)
        if most is not None and len(found) > most:
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return found[np.argsort(-score[found], kind="stable")].tolist()

    def forget(self, unused: np.ndarray):
        """Drop the postings of used documents, which no later query asks for."""
        keep = unused[self.p_doc]
        self.p_first = np.append(0, np.cumsum(keep))[self.p_first]
        self.p_doc, self.p_w = self.p_doc[keep], self.p_w[keep]
        self.held = int(np.count_nonzero(unused))


def pack_shard(docs: list[np.ndarray], index: Bm25, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence in the shard, offset in the sequence)."""
    unused = np.ones(len(docs), dtype=bool)
    rest: tuple[int, int] | None = None      # the cut document and where its rest starts
    nxt = seq = 0
    total = sum(len(d) for d in docs)
    done = 0
    while done < total:
        room, pieces = window, []
        if rest is None:
            while not unused[nxt]:
                nxt += 1
            rest = (nxt, 0)
            unused[nxt] = False
        seed, ranked, k = rest[0], None, 0
        while room and rest is not None:
            d, at = rest
            n = min(room, len(docs[d]) - at)
            pieces.append((d, at, n))
            room -= n
            rest = (d, at + n) if at + n < len(docs[d]) else None
            if rest is None and room:
                if ranked is None:
                    if np.count_nonzero(unused) < 0.7 * index.held:
                        index.forget(unused)
                    ranked = index.neighbours(seed, unused, FEW)
                while k < len(ranked) and not unused[ranked[k]]:
                    k += 1
                if k == len(ranked) >= FEW:  # more than a few fit: the others come too
                    ranked, k = index.neighbours(seed, unused), 0
                if k < len(ranked):
                    rest = (ranked[k], 0)
                else:                        # no neighbour left: the next unused document
                    while nxt < len(docs) and not unused[nxt]:
                        nxt += 1
                    rest = (nxt, 0) if nxt < len(docs) else None
                if rest is not None:
                    unused[rest[0]] = False
        done += window - room
        for d, at, n, s, off in _place(pieces, window - room, window):
            yield d, at, n, seq + s, off
        seq += 1 if room == 0 else bin(window - room).count("1")


def _place(pieces, used: int, window: int):
    """Offsets of a full window's pieces; a shorter one is cut at powers of two."""
    sizes = [window] if used == window else [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
    s = off = 0
    for d, at, n in pieces:
        while n:
            take = min(n, sizes[s] - off)
            yield d, at, take, s, off
            at, n, off = at + take, n - take, off + take
            if off == sizes[s]:
                s, off = s + 1, 0


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
         shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = QUERY,
         k1: float = 1.2, b: float = 0.75, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: ``doc_id``, ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, unless left out,
    the piece's ``ids`` (little-endian unsigned 32-bit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = 7 + with_ids
    vocab = max(Encoder(tokenizer, end_id).tok.get_vocab_size(), end_id + 1)
    small = "<u2" if vocab <= 1 << 16 else "<u4"         # ids as they are stored and dealt out

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, schema = shared_encoder(tokenizer, end_id), np.zeros(vocab, dtype=np.int64), None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), ("n", pa.int64()),
                                          ("ids", pa.binary()), ("held", pa.list_(pa.int64()))])
            for part in slices(batch, 1, rows=1000, size=3 << 20):
                ids, bounds = enc.encode_flat(part.column(1))
                held += np.bincount(distinct(ids, bounds, vocab)[1], minlength=vocab)
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), part.num_rows,
                    [None, pa.py_buffer(bounds * np.dtype(small).itemsize), pa.py_buffer(ids.astype(small))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)), raw.cast(pa.binary()),
                     pa.nulls(part.num_rows, schema.field(3).type)], schema=schema)
                enc.tidy()
        if schema:                                       # the task's document frequencies, one row
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, schema.field(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([held], schema.field(3).type)], schema=schema)

    every = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lean(encode), f"doc_id {kind}, n long, ids binary, held array<long>")
    every = stored(every.select(F.monotonically_increasing_id().alias("uid"), "*"), "packing-ids")
    coded = every.filter(F.col("ids").isNotNull()).select("uid", "doc_id", "n", "ids")
    n, total = coded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(vocab, dtype=np.int64)
    held = every.filter(F.col("held").isNotNull()).select(F.posexplode("held").alias("term", "docs"))
    for term, count in held.groupBy("term").agg(F.sum("docs")).collect():   # at most one row per token id
        df[term] = count
    stats = Stats(df, n, total / max(1, n))
    enough = ENOUGH * window / max(1.0, stats.mean)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoder()
        for batch in batches:
            if batch.num_rows:
                rows = [np.frombuffer(x.as_buffer(), dtype=small) for x in batch.column(2)]
                bounds = np.cumsum([0, *map(len, rows)])
                by = stats.route(np.concatenate(rows), bounds, enough, k1, b).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in by]],
                                                 names=["uid", "doc_id", "ids", "a", "b", "c"])

    def emit(ids, rows, index, base):
        cols = [[] for _ in range(width)]
        last = base
        for d, at, n, s, off in pack_shard(rows, index, window):
            raw = rows[d][at:at + n].astype("<u4").tobytes()
            for c, v in zip(cols, (ids[d], at, n, zlib.crc32(raw), len(rows[d]), base + s, off, raw)[:width]):
                c.append(v)
            last = max(last, base + s)
        return cols, last + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoder()
        seq = TaskContext.get().partitionId() << 40
        ids, rows, held, out = [], [], 0, None

        def close():
            nonlocal seq, ids, rows, held
            cols, seq = emit(ids, rows, Bm25(rows, vocab, k1, b, query_terms, stats), seq)
            ids, rows, held = [], [], 0
            for i in range(0, len(cols[0]), 250):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[i:i + 250], t) for c, t in zip(cols, out.types)], schema=out)

        for batch in batches:
            out = out or pa.schema([("doc_id", batch.schema.field(0).type)] + [
                (n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            ] + [("ids", pa.binary())] * with_ids)
            for d, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                rows.append(np.frombuffer(r, dtype=small))
                held += len(rows[-1])
                if len(rows) >= shard_docs or held >= shard_tokens:
                    yield from close()
        if rows:
            yield from close()

    parts = max(1, -(-n // (RUN * shard_docs)), -(-total // (RUN * shard_tokens)))
    by = ["a", "b", "c", "uid"]
    dealt = coded.select("uid", "doc_id", "ids").mapInArrow(
        lean(route), f"uid long, doc_id {kind}, ids binary, a int, b int, c int")
    return dealt.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "ids").mapInArrow(
        lean(run), SCHEMA.format(kind) + ", ids binary" * with_ids)
