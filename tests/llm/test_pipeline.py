"""The pipeline's stages, each against a brute-force version on its own input."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as P
import test_lines
import test_minhash
import test_packing
import test_substring
from pairmatch.llm.common import scratch, stored, table
from pairmatch.llm.quality import quality_rules
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, SF, "documents")]
    for name, f in P.STAGES:
        docs.append(stored(f(spark, docs[-1], SF), f"test-{name}"))
    return docs


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()))


def test_columns(stages):
    assert [s.columns for s in stages[1:-1]] == [COLUMNS] * 4
    assert all(r.n_chars == len(r.text) for s in stages[2:-1] for r in s.collect())


def test_quality(spark, stages):
    kept = {r.doc_id for r in quality_rules(stages[0], table(spark, SF, "labels")).filter("kept").collect()}
    assert rows(stages[1]) == [(d, t) for d, t in rows(stages[0]) if d in kept] and 0 < len(kept) < stages[0].count()


def test_line_dedup(stages):
    src = [(r.doc_id, r.source, r.text) for r in stages[1].collect()]
    want = sorted((int(d), t) for d, _, t, _, _ in test_lines.brute(src, 0.05, 5))
    assert rows(stages[2]) == want


def test_near_dedup(stages):
    src = rows(stages[2])
    want = sorted(min(src[i] for i in c) for c in test_minhash.brute(src))
    assert rows(stages[3]) == want


def test_substring_dedup(stages):
    src = rows(stages[3])
    gone = test_substring.brute(src, 20)
    got = rows(stages[4])
    for i, (d, t) in enumerate(src):
        want = [w for w, g in zip(t.encode().split(), gone[i]) if not g]
        assert got[i][0] == d and got[i][1].encode().split() == want


def test_packing_stage(stages):
    tok = Tokenizer.from_file(test_packing.PATH)
    tok.encode_special_tokens = True
    test_packing.check(stages[5].collect(), [(d, test_packing.direct(tok, t)) for d, t in rows(stages[4])], 2048)


def test_run(spark, stages):
    assert P.run(spark, SF).count() == stages[5].count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, own int"
LABELS = "doc_id long, quality int, toxic int, text string"


def folder(spark, name, docs, labels):
    path = scratch(spark, name)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_empty_table_through_all_stages(spark):
    out = P.run(spark, folder(spark, "pipeline-empty", [], []))
    assert out.collect() == [] and "sequence_id" in out.columns


def test_odd_rows_through_all_stages(spark):
    """Null ids, texts, hosts and labels, repeated rows, blank texts and extra columns."""
    import random
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    good = [(i, " ".join(rng.choices(words, k=60)) + "\nand a line", "en", f"s{i % 3}", None, 0.5, "x", 1) for i in range(30)]
    odd = [(None, good[3][1] + " end", None, None, None, None, None, None), (100, None, "en", "s1", 0, 1.0, "y", 2), (101, "", "en", "s1", 0, 1.0, "y", 2),
           (102, " \n\t ", "en", None, 3, None, None, 3), (103, "long " * 30_000, "en", "s2", 1, 0.0, "z", 4), good[5], good[5]]
    labels = [(i, 1, 0, "t") for i in range(20)] + [(101, 0, 0, None), (None, 0, None, None), (5, None, 1, None)]
    sf = folder(spark, "pipeline-odd", good + odd, labels)
    kept = table(spark, sf, "documents")
    for name, stage in P.STAGES[:-1]:
        kept = stored(stage(spark, kept, sf), f"odd-{name}")
        assert kept.columns == COLUMNS
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # too short or too repetitive: rejected; of the repeated rows one stays; near copies go by the smallest id
    assert ids == list(range(30))
    pieces = stored(P.STAGES[-1][1](spark, kept, sf), "odd-packing")
    assert sorted({r.doc_id for r in pieces.collect() if r.doc_id is not None}) == ids
