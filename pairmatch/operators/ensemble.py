"""Cross-fold ensemble and k-fold report.

Fold outputs are one long table with a ``fold`` column; scores are aligned by
(arg_id, key_point_id), never by row position (ledger L11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import with_scalars

KEYS = ["arg_id", "key_point_id"]


def ensemble_scores(fold_predictions: DataFrame, extra_first: Sequence[str] = ("prediction",)) -> DataFrame:
    """J9 + A20: mean score per pair over folds; ``extra_first`` columns are taken from the
    lowest fold (the reference keeps fold 0's prediction / golden_label). One aggregate with
    map-side combine: the k copies never meet in one task unpartitioned."""
    aggs = [F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_folds")]
    aggs += [F.min_by(c, "fold").alias(c) for c in extra_first]
    return fold_predictions.groupBy(*KEYS).agg(*aggs)


def attach_scores(labels: DataFrame, ensemble: DataFrame) -> DataFrame:
    """The label file with the averaged score attached by key (left join); the mean score
    is kept as ``score``, not written into ``prediction`` (ledger L12)."""
    return labels.join(ensemble.select(*KEYS, "score"), KEYS, "left")


def join_fold_metrics(dev: DataFrame, test: DataFrame) -> DataFrame:
    """The metrics of each fold on its held-out part and on the test subset, side by side."""
    return dev.join(test, "fold", "full")


def fold_report(fold_metrics: DataFrame, name: str, num_folds: int,
                map_scores: DataFrame | None = None, mode: str = "plain",
                add_info: str | None = None) -> DataFrame:
    """A19 (``_post_process_folds_report``): one report row named ``{name}_kfold`` holding the
    mean of every numeric metric over folds, epoch_stop -1, model_path '<k> folds', and the
    mAP of the ensemble when given. ``fold_metrics`` has one row per fold."""
    metric_cols = [c for c, t in fold_metrics.dtypes if c != "fold" and t in ("double", "float",
                                                                            "int", "bigint")]
    row = fold_metrics.agg(*[F.avg(c).alias(c) for c in metric_cols])
    row = row.select(F.lit(f"{name}_kfold").alias("name"), F.lit(-1).alias("epoch_stop"),
                     F.lit(mode).alias("mode"), F.lit(add_info).cast("string").alias("add_info"),
                     *metric_cols, F.lit(f"{num_folds} folds").alias("model_path"))
    if map_scores is not None:
        row = with_scalars(row, map_scores)
    return row
