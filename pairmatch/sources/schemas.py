"""Explicit schemas of the task tables and key validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARGUMENT_SCHEMA = T.StructType([
    T.StructField("arg_id", T.StringType(), False),
    T.StructField("argument", T.StringType(), True),
    T.StructField("topic", T.StringType(), False),
    T.StructField("stance", T.IntegerType(), False),
])

KEY_POINT_SCHEMA = T.StructType([
    T.StructField("key_point_id", T.StringType(), False),
    T.StructField("key_point", T.StringType(), True),
    T.StructField("topic", T.StringType(), False),
    T.StructField("stance", T.IntegerType(), False),
])

LABEL_SCHEMA = T.StructType([
    T.StructField("arg_id", T.StringType(), False),
    T.StructField("key_point_id", T.StringType(), False),
    T.StructField("label", T.IntegerType(), False),
])

PAIR_COLS = ["arg_id", "argument", "key_point_id", "key_point", "topic", "stance", "label"]

PREDICTION_SCHEMA = T.StructType([
    T.StructField("arg_id", T.StringType(), False),
    T.StructField("key_point_id", T.StringType(), False),
    T.StructField("prediction", T.IntegerType(), True),
    T.StructField("golden_label", T.IntegerType(), True),
    T.StructField("score", T.DoubleType(), True),
])

# One row of a submission: arg_id -> {key_point_id -> score}.
SUBMISSION_SCHEMA = T.StructType([
    T.StructField("arg_id", T.StringType(), False),
    T.StructField("key_points", T.MapType(T.StringType(), T.DoubleType()), False),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("run", T.StringType(), False),
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("eval_loss", T.DoubleType(), False),
])


def require_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail the job on a null key instead of silently matching/dropping it (pandas matches
    NaN keys in merges and drops them in groupby; we refuse both)."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    # A filter, not a projected column: Catalyst would prune an unused column and the check.
    return df.filter(F.when(bad, F.raise_error(F.lit(f"null key in one of {cols}")))
                     .otherwise(F.lit(True)))
