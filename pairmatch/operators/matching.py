"""Best match per argument and its gold labels (W1, J5, J6, P5-P7, A9): the submission
scorer's ``get_predictions``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import split_known

DUMMY_ID = "dummy_id"


def best_match(scored: DataFrame, key_points: DataFrame | None = None) -> DataFrame:
    """Per arg_id the key point with the highest score among known key points; ties go to
    the smallest key_point_id (the first maximum in a sorted-key submission). Arguments with
    no known key point, or no score (null or NaN), are dropped.

    An aggregate, not a window: ``min(struct(-score, key_point_id))`` combines map-side, so a
    hot argument never lands whole in one task.
    """
    if key_points is not None:
        scored, _ = split_known(scored, key_points)
    scored = scored.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    best = scored.groupBy("arg_id").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("key_point_id"))).alias("_b"))
    return best.select("arg_id", F.col("_b.key_point_id").alias("key_point_id"),
                       (-F.col("_b.neg")).alias("score"))


def complete_arguments(arguments: DataFrame, best: DataFrame) -> DataFrame:
    """J5 + P5: every argument keeps one row; without a prediction it gets the dummy key point
    and score 0."""
    return (arguments.select("arg_id", "topic", "stance")
            .join(best, "arg_id", "left")
            .select("arg_id", "topic", "stance",
                    F.coalesce("key_point_id", F.lit(DUMMY_ID)).alias("key_point_id"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))


def attach_gold(matched: DataFrame, labels: DataFrame) -> DataFrame:
    """J6 + P6: gold label by (arg_id, key_point_id); dummies are 0; pairs without a gold row
    are 0 for the strict and 1 for the relaxed label."""
    m = matched.join(labels.select("arg_id", "key_point_id", "label"),
                     ["arg_id", "key_point_id"], "left")
    label = F.when(F.col("key_point_id") == DUMMY_ID, F.lit(0)).otherwise(F.col("label"))
    return (m.withColumn("label", label.cast("int"))
            .withColumn("label_strict", F.coalesce("label", F.lit(0)).cast("int"))
            .withColumn("label_relaxed", F.coalesce("label", F.lit(1)).cast("int")))


def get_predictions(scored: DataFrame, arguments: DataFrame, key_points: DataFrame,
                    labels: DataFrame) -> DataFrame:
    """W1 -> J5 -> J6: arg_id, topic, stance, key_point_id, score, label, label_strict,
    label_relaxed (one row per argument)."""
    best = best_match(scored, key_points)
    return attach_gold(complete_arguments(arguments, best), labels)


def match_coverage(matched: DataFrame) -> DataFrame:
    """Per (stance, topic), arguments and how many got a real key point."""
    return (matched.groupBy("stance", "topic")
            .agg(F.count(F.lit(1)).alias("n_arguments"),
                 F.count(F.when(F.col("key_point_id") != DUMMY_ID, 1)).alias("n_matched"))
            .withColumn("coverage", F.round(F.col("n_matched") / F.col("n_arguments"), 6)))
