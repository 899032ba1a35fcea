"""Packing: documents meet by content, not by where they stand in the input."""

import numpy as np
import public_tokenizers as P

from pairmatch.llm.packing import Bm25, pack

PATH = P.path("word_bpe_49k.json")


def test_neighbours_wherever_they_stand(spark):
    """Documents of a topic stand in different input partitions; their windows hold one topic."""
    rng = np.random.default_rng(5)
    topics = [["apple", "pear", "plum", "cherry"], ["engine", "wheel", "brake", "clutch"], ["violin", "cello", "flute", "drum"],
              ["river", "lake", "ocean", "creek"], ["doctor", "nurse", "clinic", "fever"], ["king", "queen", "prince", "crown"]]
    rows = [(i, " ".join(rng.permutation(topics[i % 6] * 5 + ["the", "and"] * 8))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seqs = {}
    for r in pack(df, PATH, window=128, shard_docs=40).collect():
        seqs.setdefault(r.sequence_id, set()).add(r.doc_id % 6)
    assert sum(map(len, seqs.values())) < 1.2 * len(seqs)


def test_weights_of_all_documents():
    """A shard in which most documents are copies still finds them by the weights of the corpus."""
    from pairmatch.llm.packing import Stats
    docs = [np.array([3, 4, 5], dtype=np.uint32)] * 3 + [np.array([6, 7], dtype=np.uint32)]
    df = np.zeros(10, dtype=np.int64)
    df[[3, 4, 5, 6, 7]] = 3, 3, 3, 1, 1
    index = Bm25(docs, 10, 1.2, 0.75, stats=Stats(df, 100, 2.75))
    assert index.neighbours(0, np.array([False, True, True, True])) == [1, 2]
