"""The dedup stream against plain grouping, digest clashes, and state that outlives a run."""

import hashlib
import re

from pyspark.sql import functions as F

from pairmatch.llm.common import scratch
from pairmatch.llm.exact import dedup_stream, run_stream

ROWS = [(5, "a b\nc"), (2, "abc"), (9, " a  b c "), (1, "other"), (7, None), (8, ""), (3, " \t\n"), (4, "é x"), (None, "é x "),
        (2, "abc"), (2, "abc"), (6, "long " * 20000)]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def write(spark, rows, files=1):
    path = scratch(spark, "dedup-in") + "/documents.parquet"
    spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, digest string").repartition(files).write.parquet(path)
    return path


def check(out, rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    assert len(out) == len(rows)
    kept = {}
    for r in out:
        (n, g) = next((k, v) for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(g) and r.keep_id == min(g)[3]
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[n] = kept.get(n, 0) + 1
    assert kept == dict.fromkeys(groups, 1)


def test_groups(spark):
    check(dedup_stream(spark, write(spark, ROWS, 3), files_per_batch=1).collect(), ROWS)


def test_texts_that_share_a_digest(spark):
    weak = lambda n: F.pmod(F.crc32(n), F.lit(3)).cast("string")
    check(dedup_stream(spark, write(spark, ROWS), digest=weak).collect(), ROWS)


def test_empty_table(spark):
    assert dedup_stream(spark, write(spark, [])).collect() == []


def test_state_is_kept_between_runs(spark):
    """A second run on the same checkpoint counts the new files on top of the old ones."""
    path, checkpoint, out = write(spark, [(1, "x y"), (2, "z")]), scratch(spark, "c"), scratch(spark, "o")
    schema = spark.read.parquet(path).schema
    run_stream(spark, path, schema, checkpoint, out)
    spark.createDataFrame([(0, "xy", "s")], schema).write.mode("append").parquet(path)
    run_stream(spark, path, schema, checkpoint, out)
    last = [r for r in spark.read.parquet(out).collect() if r.epoch == 1]
    assert [(r.size, r.keep.doc_id) for r in last] == [(2, 1)]
