"""Columns of the input whose names the operators use themselves."""

import os

import pytest

from pairmatch.llm.common import scratch
from pairmatch.llm.exact import STATE_CONF, dedup_stream, run_stream
from pairmatch.llm.lines import site_line_dedup
from pairmatch.llm.lm import score_texts
from pairmatch.llm.minhash import near_duplicates
from pairmatch.llm.substring import remove_repeats


def test_line_dedup_carries_any_name(spark):
    names = ("all", "kept", "drop", "host", "site", "_all", "_kept", "_site", "_drop", "own", "page", "line")
    rows = [(i, "h", f"menu\nbody {i}", *[f"{n}{i}" for n in names]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in names))
    out = site_line_dedup(df, carry=("doc_id", *names)).collect()
    assert len(out) == 6
    for r in out:
        assert r.text == f"body {r.doc_id}" and (r.n_lines, r.n_dropped) == (2, 1)
        assert all(r[n] == f"{n}{r.doc_id}" for n in names)


@pytest.mark.parametrize("operator, name", [(site_line_dedup, "n_lines"), (score_texts, "score"), (remove_repeats, "n_words"), (near_duplicates, "kept")])
def test_result_names_are_refused(spark, operator, name):
    df = spark.createDataFrame([(1, "s", "a b", "x")], f"doc_id long, source string, text string, {name} string")
    with pytest.raises(ValueError):
        operator(df, carry=("doc_id", name))


def test_stream_dedup_with_a_metadata_column(spark):
    path = scratch(spark, "meta-in") + "/documents.parquet"
    spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, None, None)], "doc_id long, text string, _metadata string").write.parquet(path)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in dedup_stream(spark, path).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_many_state_partitions_take_little_disk(spark):
    """RocksDB's files of 200 small state partitions: kilobytes each, not megabytes set aside."""
    assert STATE_CONF["spark.sql.streaming.stateStore.rocksdb.allowFAllocate"] == "false"
    path = scratch(spark, "state-in") + "/documents.parquet"
    spark.createDataFrame([(i, f"text {i % 700}") for i in range(1000)], "doc_id long, text string").write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        checkpoint, out = scratch(spark, "state-checkpoint"), scratch(spark, "state-out")
        run_stream(spark, path[:-1] + f"[{path[-1]}]", spark.read.parquet(path).schema, checkpoint, out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    size = sum(os.stat(os.path.join(d, f)).st_blocks * 512 for d, _, files in os.walk(checkpoint.removeprefix("file://")) for f in files)
    assert size < 200 * 100_000
    assert spark.read.parquet(out).count() == 700
