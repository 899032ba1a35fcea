"""Scoring plumbing: batch numbering (W5) and the outside-scorer extension point (M3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import global_rank


def number_batches(df: DataFrame, order_cols: Sequence[str], batch_size: int = 64,
                   out: str = "batch_id") -> DataFrame:
    """Consecutive fixed-size batches in a total order (unshuffled data loader):
    batch = (rank - 1) div batch_size, the rank from the distributed two-level rank."""
    ranked = global_rank(df, [F.col(c).asc() for c in order_cols], out="_pm_rank")
    return ranked.withColumn(out, F.floor((F.col("_pm_rank") - 1) / F.lit(batch_size))
                             .cast("long")).drop("_pm_rank")


LOGIT_SCHEMA = T.StructType([T.StructField("l0", T.DoubleType()), T.StructField("l1", T.DoubleType())])


def score_with(pairs: DataFrame, scorer_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
               key_cols: Sequence[str] = ("arg_id", "key_point_id"),
               text_cols: Sequence[str] = ("argument_clean", "key_point_clean")) -> DataFrame:
    """M3 extension point: run any outside pair scorer (a transformer, an ONNX model, ...) with
    ``mapInPandas``. ``scorer_factory`` is called once per task (one model load per task, not
    per row) and returns a function mapping a pandas batch of ``text_cols`` to a frame with
    float logits ``l0``, ``l1``. Rows stream through in Arrow batches; nothing is collected."""
    keys, texts = list(key_cols), list(text_cols)
    schema = T.StructType([pairs.schema[c] for c in keys] + list(LOGIT_SCHEMA.fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for b in batches:
            logits = scorer(b[texts])
            out = b[keys].reset_index(drop=True)
            out["l0"] = logits["l0"].astype("float64").to_numpy()
            out["l1"] = logits["l1"].astype("float64").to_numpy()
            yield out

    return pairs.select(*keys, *texts).mapInPandas(run, schema)
