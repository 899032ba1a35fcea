"""Run-level plans (M5 and the k-fold flow): compose scoring outputs and task tables into the
report row, the submission and the prediction file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble, matching, metrics, pairs
from ..operators.sizing import with_scalars
from ..sources import io


def calc_map(scored: DataFrame, arguments: DataFrame, key_points: DataFrame,
             labels: DataFrame) -> DataFrame:
    """Entry 3 (``calc_map``): submission rows -> best match -> gold -> mAP strict / relaxed."""
    matched = matching.get_predictions(scored.select("arg_id", "key_point_id", "score"),
                                       arguments, key_points, labels)
    return metrics.mean_average_precision(matched)


def labelled_scores(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored pairs with their gold label (the eval / test_eval prediction frames)."""
    return scored.join(labels.select("arg_id", "key_point_id", "label"),
                       ["arg_id", "key_point_id"])


def evaluate_run(name: str, dev_scored: DataFrame, dev_labels: DataFrame,
                 test_scored: DataFrame, test_arguments: DataFrame, test_key_points: DataFrame,
                 test_labels: DataFrame, epoch_stop: int = -1, mode: str = "plain",
                 add_info: str | None = None, model_path: str = "") -> DataFrame:
    """M5 (``train.run`` after training): one report row with dev metrics, test metrics
    suffixed ``_test`` and the submission mAP on the test subset."""
    dev = metrics.binary_metrics(labelled_scores(dev_scored, dev_labels))
    test = metrics.binary_metrics(labelled_scores(test_scored, test_labels), suffix="_test")
    mAP = calc_map(test_scored, test_arguments, test_key_points, test_labels)
    row = with_scalars(with_scalars(dev, test), mAP)
    return row.select(F.lit(name).alias("name"), F.lit(epoch_stop).alias("epoch_stop"),
                      F.lit(mode).alias("mode"), F.lit(add_info).cast("string").alias("add_info"),
                      *[c for c in row.columns], F.lit(model_path).alias("model_path"))


def run_experiment(out_dir: str, name: str, dev_scored: DataFrame, dev_labels: DataFrame, test_scored: DataFrame,
                   test_arguments: DataFrame, test_key_points: DataFrame, test_labels: DataFrame,
                   report_path: str | None = None, **kw) -> dict[str, str]:
    """M5 with its sinks: the test submission, the prediction file, and the report of
    ``report_path`` (none: a new one) with this run's row replaced or added. Everything is
    written under ``out_dir``; returns the paths."""
    spark = test_scored.sparkSession
    row = evaluate_run(name, dev_scored, dev_labels, test_scored, test_arguments, test_key_points, test_labels, **kw)
    old = io.read_report(spark, report_path) if report_path else None
    return {"submission": io.write_submission(test_scored, f"{out_dir}/submission"),
            "predictions": io.write_predictions(test_scored, f"{out_dir}/predictions"),
            "report": io.write_report(io.report_upsert(old, row), f"{out_dir}/report")}


def kfold_run(name: str, fold_scored: DataFrame, arguments: DataFrame, key_points: DataFrame,
              labels: DataFrame, num_folds: int, dev_scored: DataFrame | None = None,
              test_labelled: DataFrame | None = None, mode: str = "plain",
              add_info: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The k-fold report (A19) and the ensemble scores (J9, A20) from per-fold scoring outputs.

    ``fold_scored``: every fold's (fold, arg_id, key_point_id, score, prediction) of the test
    candidates. ``dev_scored``: each fold's labelled scores of its own held-out pairs (ledger L13); the
    report then has the metrics of both parts, 16 in all. ``test_labelled``: the labelled rows of
    ``fold_scored`` where the caller has them cheaper than by a join of all folds."""
    lab = labelled_scores(fold_scored, labels) if test_labelled is None else test_labelled
    per_fold = metrics.binary_metrics(lab, group_cols=["fold"], suffix="_test")
    if dev_scored is not None:
        per_fold = ensemble.join_fold_metrics(metrics.binary_metrics(dev_scored, group_cols=["fold"]), per_fold)
    first = [c for c in ("prediction", "golden_label") if c in fold_scored.columns]
    ens = ensemble.ensemble_scores(fold_scored, first)
    mAP = calc_map(ens, arguments, key_points, labels)
    return ensemble.fold_report(per_fold, name, num_folds, mAP, mode, add_info), ens


def run_folds(spark: SparkSession, run_dir: str, num_folds: int,
              fold_scores: Callable[[int], DataFrame]) -> DataFrame:
    """M4 / A19 as a run that can be taken up again: ``fold_scores(f)`` is planned and written under
    ``run_dir`` for each fold that has no committed result there, in order; folds of an earlier,
    interrupted run are kept as they are. Returns all folds as one table with a ``fold`` column.

    A fold counts as committed when Spark's marker of a finished job is in its folder, so what a
    killed run left half-written is written anew."""
    paths = [f"{run_dir}/fold={f}" for f in range(num_folds)]
    for f, path in enumerate(paths):
        if not io.path_exists(spark, f"{path}/_SUCCESS"):
            fold_scores(f).write.mode("overwrite").parquet(path)
    return spark.read.option("basePath", run_dir).parquet(*paths)


def load_pairs(spark: SparkSession, root: str, subset: str, ratio: float = 1.0, seed: int = 42,
               submitted_kp_file: str | None = None, fmt: str = "csv") -> DataFrame:
    """The pairs of a subset from its task files, by name: ``test`` gives every candidate pair with its
    gold label where there is one (J3, J4); ``test_eval`` the labelled pairs of the same files; ``train``,
    ``dev`` (or ``eval``) their labelled pairs (J1, J2), reduced to those of a ``ratio`` of the
    arguments (T4). Scoring subsets are never sampled (ledger L29)."""
    arguments, key_points, labels = io.load_task_tables(spark, subset=subset, root=root, submitted_kp_file=submitted_kp_file, fmt=fmt)
    if subset == "test":
        return pairs.candidate_pairs(arguments, key_points, labels)
    out = pairs.labelled_pairs(arguments, key_points, labels)
    return out if subset == "test_eval" else pairs.sample_arguments(out, ratio, seed)
