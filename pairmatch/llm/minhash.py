"""Near-duplicate detection with BagMinHash (operator 7).

A document is the multiset of its five-word shingles, each weighted by its count. BagMinHash gives
every unit of weight of every shingle its own Poisson process of (time, slot) points and keeps, per
slot, the earliest point; two documents agree in a slot with a probability that is exactly their
weighted Jaccard similarity. Processes are hierarchical: the weights (0, 1], (1, 2], (2, 4], (4, 8],
... share one process each, whose points carry a place in the interval and count only up to the
document's own weight, so a heavy shingle costs points, not units. Points are generated in time
order only up to the time at which all slots are filled.

Signatures are cut into bands. Candidates that share a band are verified on the multisets
themselves, and the classes are the connected components of the links of at least ``similarity``.

* Documents with equal multisets are one class from the start, with one representative.
* In a bucket (documents that share a band) every member is first compared with the bucket's
  leader, the member whose buckets are largest: as many pairs as members, however large the bucket.
* Where a bucket still holds more than one component, its documents are compared across components
  if they share a shingle among their rarest ones (prefix filtering, which is exact: documents of
  the wanted similarity always do). Pairs inside a component need no comparison, so no link that
  matters for a class is left out.

Plan: one map stage over blocks of documents computes signatures; only (digest, row number) and
(band, row number) rows are shuffled and combined map-side. Shingles are sent only for documents
that have a candidate. Joins are equi-joins that AQE splits when one bucket is hot. Components are
label propagation with pointer jumping over the links, each round written to the shared folder;
nothing but a row count reaches the driver.

Words are cut at white space. A text of one to four words has one shingle, all its words; null,
empty and blank texts have none, and each is a class of its own. Repeated rows are equal documents.
A class is named by its smallest doc_id, a null id counting as largest; the kept document is the
one with that id, and of equal ids the first row. An empty table gives an empty result; of the
other columns only those in ``carry`` are kept; one that is named like a result column is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_words, blocks, gram_hash, lean, mix, open_block, refuse_clash, stored, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5            # at similarity 0.8 a pair shares a band with probability 0.9996
GRAM_BASE = 0x9E3779B97F4A7C15
SHIFT = 11                     # a row's number: its block's number and its place in the block (of at most 500)
STEP = 0xD1342543DE82EF95
U, WRAP = np.uint64, 1 << 64


def shingles(body: bytes, lens: bytes, words: int = WORDS):
    """(document, shingle, weight) of the distinct shingles of a block, ordered by document and
    shingle."""
    ids, distinct, n = block_words(open_block(body, lens))
    h = word_hashes(distinct)[0][ids] if len(ids) else np.empty(0, dtype=U)
    first = np.concatenate([[0], np.cumsum(n)])
    grams = gram_hash(h, words, GRAM_BASE)
    left = np.repeat(first[1:], n) - np.arange(len(ids))
    start = np.flatnonzero(left >= words)
    doc, g = np.repeat(np.arange(len(n)), n)[start], grams[start]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = np.array([gram_hash(h[first[d]:first[d + 1]], int(n[d]), GRAM_BASE)[0] + U(n[d]) for d in short], dtype=U)
        doc, g = np.concatenate([doc, short]), np.concatenate([g, whole])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    return doc[at], g[at], np.diff(np.append(at, len(g))), len(n)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """The earliest time per document and slot; infinite for documents without shingles."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    out = np.full(n_docs * slots, np.inf)
    # one process per shingle and dyadic interval of weights that the document reaches into
    parts = []
    low, k = 0, 0
    reach = np.arange(len(doc))
    while len(reach):
        parts.append((reach, np.full(len(reach), low), np.full(len(reach), max(1, low)), mix(shingle[reach] + U(k * GRAM_BASE % WRAP))))
        low, k = max(1, 2 * low), k + 1
        reach = reach[weight[reach] > low]
    if not parts:
        return out.reshape(n_docs, slots)
    of, lower, size, seed = (np.concatenate(x) for x in zip(*parts))
    todo = total > 0
    limit = np.where(todo, (np.log(slots) + 4) / np.maximum(total, 1), 0.0)
    while todo.any():
        use = todo[doc[of]]
        d, w, lo, sz, s = doc[of][use], weight[of][use], lower[use], size[use], seed[use]
        t, c = np.zeros(len(d)), 0
        while len(d):
            c += 1
            r = mix(s + U(c * STEP % WRAP))
            t = t - np.log(_uniform(r)) / (slots * sz)
            alive = t < limit[d]
            d, w, lo, sz, s, t, r = d[alive], w[alive], lo[alive], sz[alive], s[alive], t[alive], r[alive]
            place = mix(r ^ U(0x632BE59BD9B4E019))
            slot = (place >> U(32)).astype(np.int64) % slots
            cell = lo + 1 + ((place & U(0xFFFFFFFF)).astype(np.int64) * sz >> 32)
            counts = cell <= w
            np.minimum.at(out, d[counts] * slots + slot[counts], t[counts])
        empty = np.isinf(out.reshape(n_docs, slots)).any(axis=1)
        todo &= empty                       # a slot without a point: generate further in time
        limit = np.where(todo, 2 * limit, limit)
    return out.reshape(n_docs, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    bits = sig.view(U).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * U(GRAM_BASE)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key ^ bits[:, :, r]) + U(r + 1)
    return key


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _signed(parts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """uid, digest of the multiset (two 64-bit halves) and band keys of every document with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, lens in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                doc, g, w, n = shingles(body, lens, words)
                if not len(doc):
                    continue
                sig = signatures(doc, g, w, n, bands * rows)
                at = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
                has = doc[at]
                h1, h2 = (np.add.reduceat(mix(mix(g ^ U(k)) + w.astype(U)), at) for k in (1, 2))
                keys = band_keys(sig[has], bands, rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array((block << SHIFT) + has, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    _lists(keys.ravel().view(np.int64), np.full(len(has), bands), pa.int64())],
                    names=["uid", "h1", "h2", "keys"])
    return parts.select("block", "body", "lens").mapInArrow(lean(run), "uid long, h1 long, h2 long, keys array<bigint>")


def _bags(parts: DataFrame, uids: DataFrame, words: int) -> DataFrame:
    """uid, shingles (ascending), weights and total weight of the documents ``uids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, lens, idx in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                doc, g, w, n = shingles(body, lens, words)
                use = np.isin(doc, np.array(idx, dtype=np.int64))
                doc, g, w = doc[use], g[use], w[use]
                at = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
                counts = np.diff(np.append(at, len(doc)))
                yield pa.RecordBatch.from_arrays([
                    pa.array((block << SHIFT) + doc[at], pa.int64()),
                    _lists(g.view(np.int64), counts, pa.int64()), _lists(w.astype(np.int32), counts, pa.int32()),
                    pa.array(np.add.reduceat(w, at) if len(at) else w, pa.int64())], names=["uid", "g", "w", "n"])
    wanted = uids.groupBy(F.shiftright("uid", SHIFT).alias("block")).agg(
        F.collect_list(F.col("uid").bitwiseAND((1 << SHIFT) - 1)).alias("idx"))
    return (parts.select("block", "body", "lens").join(wanted, "block").select("block", "body", "lens", "idx")
            .mapInArrow(lean(run), "uid long, g array<bigint>, w array<int>, n long"))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``a``, ``b`` and their weighted Jaccard similarity ``sim``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k) for k in range(2, 6)]
            sims = []
            for i in range(batch.num_rows):
                ga, wa, gb, wb = (c[i].values.to_numpy() for c in cols)
                _, ia, ib = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
                both = int(np.minimum(wa[ia], wb[ib]).sum())
                sims.append(both / (int(wa.sum()) + int(wb.sum()) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())],
                                             names=["a", "b", "sim"])
    left = bags.select(F.col("uid").alias("a"), F.col("g").alias("ga"), F.col("w").alias("wa"))
    right = bags.select(F.col("uid").alias("b"), F.col("g").alias("gb"), F.col("w").alias("wb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "wa", "gb", "wb")
            .mapInArrow(lean(run), "a long, b long, sim double"))


def _cross(bags: DataFrame, rest: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components of ``rest`` that can reach ``similarity``, by prefix
    filtering: with the shingles of every document in one order, rare ones first, two documents
    that are similar enough share a shingle within the first ones of both, and from the first one
    that they share there is still enough weight left in both. Of the documents that have a
    shingle so early, those outside its most frequent component are joined with the others."""
    own = stored(bags.join(rest.select("uid"), "uid").select("uid", "n", F.explode(F.arrays_zip("g", "w")).alias("e"))
                 .select("uid", "n", F.col("e.g").alias("g"), F.col("e.w").alias("w")), "near-units")
    often = own.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    before = Window.partitionBy("uid").orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)
    first = (own.join(often, "g", "left").withColumn("df", F.coalesce("df", F.lit(1)))
             .withColumn("left", F.col("n") - F.coalesce(F.sum("w").over(before), F.lit(0)))
             .filter(F.col("left") >= F.ceil(F.col("n") * similarity - 1e-9)).filter("df > 1")
             .join(rest, "uid").select("g", "uid", "n", "left", "comp"))
    first = stored(first, "near-prefixes")
    top = (first.groupBy("g", "comp").agg(F.count("*").alias("k")).groupBy("g")
           .agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
           .select("g", F.col("top.comp").alias("top")))
    ranked = first.join(top, "g")
    x, y = ranked.filter("comp != top").alias("x"), ranked.drop("top").alias("y")
    both = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    return (x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.comp") != F.col("y.comp"))
                   & ((F.col("y.comp") == F.col("x.top")) | (F.col("x.uid") > F.col("y.uid")))
                   & (F.least("x.left", "y.left") >= both))
            .select(F.greatest("x.uid", "y.uid").alias("a"), F.least("x.uid", "y.uid").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """``uid`` and ``comp`` (its component's smallest uid) of every end of a link (a, b)."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    label = stored(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.col("uid")).alias("comp")), "near-label")
    while True:
        near = both.join(label.select(F.col("uid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("comp").alias("near"))
        step = label.join(near, "uid").select("uid", "comp", F.least("comp", "near").alias("next"))
        jump = label.select(F.col("uid").alias("next"), F.col("comp").alias("far"))
        new = stored(step.join(jump, "next").select("uid", F.col("comp").alias("old"), F.least("next", "far").alias("comp")), "near-label")
        done = new.filter(F.col("old") != F.col("comp")).isEmpty()
        label = new.select("uid", "comp")
        if done:
            return label


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns (doc_id among them), ``class_id``, ``class_size`` and ``kept`` of every row."""
    carry = list(dict.fromkeys(["doc_id", *carry]))
    refuse_clash(carry, ("class_id", "class_size", "kept"))
    parts = blocks(docs.select(*carry, *[c for c in ["text"] if c not in carry]), carry, "near-blocks", bucketed=True)
    return _classes(parts, words, similarity, bands, rows).select("d.*", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
             rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that are the kept document of their class (null texts
    come back empty). Texts move once more, inside their blocks."""
    carry = [c for c in docs.columns if c != "text"]
    parts = blocks(docs, carry, "near-blocks", bucketed=True)
    kept = (_classes(parts.withColumn("d", F.transform("d", lambda x: F.struct(x["doc_id"].alias("doc_id")))),
                     words, similarity, bands, rows).filter("kept")
            .groupBy(F.shiftright("uid", SHIFT).alias("block")).agg(
                F.collect_list(F.col("uid").bitwiseAND((1 << SHIFT) - 1)).alias("idx")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, body, lens, idx = (batch.column(c)[i] for c in range(4))
                texts = open_block(body.as_py(), lens.as_py())
                at = pa.array(sorted(idx.as_py()), pa.int64())
                for j in range(0, len(at), 200):
                    yield pa.RecordBatch.from_arrays(
                        [d.values.take(at.slice(j, 200)), texts.take(at.slice(j, 200)).cast(pa.string())], names=["d", "text"])

    kind = parts.schema["d"].dataType.elementType.simpleString()
    out = parts.select("block", "d", "body", "lens").join(kept, "block").select("d", "body", "lens", "idx").mapInArrow(
        lean(run), f"d {kind}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"d.{c}") for c in docs.columns])


def _classes(parts: DataFrame, words: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """uid, ``d``, class_id, class_size and kept of every row of the blocks."""
    signed = stored(_signed(parts, words, bands, rows), "near-signatures")
    reps = signed.groupBy("h1", "h2").agg(F.min("uid").alias("rep"))
    member = stored(signed.select("uid", "h1", "h2").join(reps, ["h1", "h2"]).select("uid", "rep"), "near-members")

    # buckets of representatives; a bucket's leader is its member in the largest company
    keyed = signed.join(member.filter("uid = rep").select("uid"), "uid").select("uid", F.explode("keys").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bucket = stored(keyed.join(full, "key"), "near-buckets")
    company = bucket.groupBy("uid").agg(F.sum("n").alias("company"))
    leaders = bucket.join(company, "uid").groupBy("key").agg(
        F.max(F.struct("company", (-F.col("uid")).alias("uid"))).alias("top")).select("key", (-F.col("top.uid")).alias("leader"))
    led = bucket.select("key", "uid").join(leaders, "key")
    pairs = stored(led.filter("uid != leader").select(F.col("uid").alias("a"), F.col("leader").alias("b")).distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    bags = stored(_bags(parts, ends, words), "near-bags")
    links = stored(_verified(pairs, bags), "near-first").filter(F.col("sim") >= similarity).select("a", "b")
    comp = components(links)

    # buckets that still hold more than one component
    known = bucket.select("key", "uid").join(comp, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("key")
    rest = stored(known.join(mixed, "key").select("uid", "comp").distinct(), "near-rest")
    cross = stored(_cross(bags, rest, similarity).join(pairs, ["a", "b"], "left_anti")
                   .join(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "near-cross")
    more = stored(_verified(cross, bags).filter(F.col("sim") >= similarity).select("a", "b"), "near-more")
    if not more.isEmpty():
        comp = components(links.unionByName(more))

    named = (parts.select("block", F.posexplode("d").alias("i", "d"))
             .select((F.shiftleft("block", SHIFT) + F.col("i")).alias("uid"), "d")
             .join(member, "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
             .join(comp.withColumnRenamed("uid", "rep"), "rep", "left")
             .select("uid", "d", F.coalesce("comp", "rep").alias("comp")))
    best = named.groupBy("comp").agg(
        F.min(F.struct(F.col("d.doc_id").isNull().alias("none"), F.col("d.doc_id").alias("doc_id"), "uid")).alias("best"),
        F.count("*").alias("class_size"))
    return named.join(best, "comp").select(
        "uid", "d", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("best.uid")).alias("kept"))
