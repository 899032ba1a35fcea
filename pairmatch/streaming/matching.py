"""Streaming argument matching.

Arguments arrive as a stream (new files in a folder); key points are a static table. Candidate
generation is a stream-static join (key points broadcast if they are small), scoring is a
row expression, and the best match of each argument is complete inside the micro-batch that
carries the argument (all its candidates are generated from that one row), so no state is kept.
Each micro-batch is written under its epoch id with overwrite: a batch replayed after a failure
replaces its own output (exactly-once effect on the sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scores import sigmoid
from ..operators.matching import best_match
from ..sources.fixtures import (LOGIT_SCALE, arguments_from_documents, key_points_raw,
                                read_table, with_logits)


def document_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The ``documents`` table read as a file stream (a glob: the file source needs a folder
    or a pattern)."""
    schema = read_table(spark, sf_dir, "documents").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{sf_dir}/documents*.parquet")


def scored_candidate_stream(arguments_stream: DataFrame, key_points: DataFrame) -> DataFrame:
    """Stream-static candidate join + fixture scorer: arg_id, key_point_id, score."""
    a = arguments_from_documents(arguments_stream).select(
        "doc_id", "tid", "stance", "arg_id", "topic", "subset")
    k = key_points.select("item_id", "tid", "stance", "key_point_id")
    pairs = with_logits(a.join(k, ["tid", "stance"]))
    score = sigmoid((F.col("l1") - F.col("l0")).cast("double") / F.lit(LOGIT_SCALE))
    return pairs.select("arg_id", "key_point_id", score.alias("score"))


def start_best_match_stream(spark: SparkSession, sf_dir: str, out_path: str, checkpoint: str,
                            available_now: bool = True) -> StreamingQuery:
    """Best key point per streamed argument, appended to ``out_path`` (parquet)."""
    kps = key_points_raw(spark, sf_dir)
    scored = scored_candidate_stream(document_stream(spark, sf_dir), kps)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        (best_match(batch).write.mode("overwrite")
         .parquet(f"{out_path}/epoch={epoch_id}"))

    w = scored.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
