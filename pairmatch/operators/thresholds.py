"""Decision thresholds and early stopping.

Threshold searches never loop over the grid: distinct scores are bucketed into the grid with
an O(1) closed-form index (corrected by one exact comparison each side), counts are summed per
grid bucket (a table no larger than the grid), and F1 at every grid point comes from running
sums over that small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import best_match
from .metrics import precision_recall_curve
from .sizing import materialize, with_scalars

# Fixed values of the reference's (disabled) threshold modes.
F1_GRID = ("log", -1.0, 0.0, 5000)      # np.logspace(-1, 0, 5000)
BEST_MATCH_GRID = ("lin", 0.0, 0.1, 100)  # np.linspace(0, 0.1, 100)


def grid_value(kind: str, lo: float, hi: float, n: int) -> Callable[[Column], Column]:
    """Threshold i of the grid as an expression of i (numpy's linspace / logspace)."""
    step = (hi - lo) / (n - 1)

    def th(i: Column) -> Column:
        x = F.when(i == n - 1, F.lit(hi)).otherwise(F.lit(lo) + i.cast("double") * F.lit(step))
        return F.pow(F.lit(10.0), x) if kind == "log" else x
    return th


def grid_count_at_or_below(s: Column, kind: str, lo: float, hi: float, n: int) -> Column:
    """How many grid thresholds are <= s (so s >= th_i iff i < result)."""
    th = grid_value(kind, lo, hi, n)
    step = (hi - lo) / (n - 1)
    pos = F.log10(s) if kind == "log" else s
    guess = F.floor((pos - F.lit(lo)) / F.lit(step)) + 1
    b0 = F.least(F.greatest(F.coalesce(guess, F.lit(0)), F.lit(0)), F.lit(n)).cast("int")
    b1 = F.when((b0 > 0) & (th(b0 - 1) > s), b0 - 1).otherwise(b0)
    return F.when((b1 < n) & (th(b1) <= s), b1 + 1).otherwise(b1)


def grid_grid(spark, kind: str, lo: float, hi: float, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"),
                                 grid_value(kind, lo, hi, n)(F.col("id")).alias("threshold"))


def _grid_suffix(g: DataFrame, per: DataFrame, cols: list[str]) -> DataFrame:
    """For each grid index i, the sums of ``cols`` over buckets b > i, i.e. over the scores
    s >= th_i. ``per`` has one row per bucket (at most n + 1 rows); bucket i + 1 is joined by
    key and a suffix sum runs over the grid-sized table."""
    j = g.join(F.broadcast(per), F.col("b") == F.col("i") + 1, "left")  # <= grid size + 1 rows
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select("i", "threshold", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(c)
                                        for c in cols])


def _first_best(df: DataFrame, value: str, order_key: Column) -> DataFrame:
    """Row with the largest ``value``; ties -> smallest ``order_key`` (first in the loop)."""
    best = df.agg(F.min(F.struct((-F.col(value)).alias("v"), order_key.alias("o"),
                                 F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), (-F.col("b.v")).alias(value))


def f1_threshold(scored: DataFrame, label: str = "label", score: str = "score",
                 grid: tuple = F1_GRID) -> DataFrame:
    """The grid threshold with the highest F1 of ``score >= threshold`` (first maximum in
    ascending order); -1 when no threshold beats F1 = 0."""
    kind, lo, hi, n = grid
    spark = scored.sparkSession
    b = scored.select(grid_count_at_or_below(F.col(score), kind, lo, hi, n).alias("b"),
                      (F.col(label) == 1).cast("long").alias("y"))
    per = b.groupBy("b").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    g = grid_grid(spark, kind, lo, hi, n)
    totals = per.agg(F.sum("pos").alias("P"))
    j = _grid_suffix(g, per, ["pos", "cnt"]).withColumnsRenamed({"pos": "tp", "cnt": "n_ge"})
    j = with_scalars(j, totals)
    tp = F.coalesce(F.col("tp"), F.lit(0))
    nge = F.coalesce(F.col("n_ge"), F.lit(0))
    f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), (nge + F.col("P")).cast("double")),
                    F.lit(0.0))
    j = j.withColumn("f1", f1)
    best = _first_best(j, "f1", F.col("i"))
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(-1.0))
                       .alias("threshold"), "f1")


def youden_threshold(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The ROC threshold maximising tpr - fpr (ties -> the higher threshold). The input is read
    once: its curve (a row per distinct score) is stored, and its last point holds the totals."""
    curve = materialize(precision_recall_curve(scored, label, score).select("threshold", "tp", "fp"), "roc-curve")
    tot = curve.agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    c = with_scalars(curve, tot).select(
        "threshold",
        F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double")).alias("fpr"))
    c = c.withColumn("youden", F.col("tpr") - F.col("fpr"))
    best = c.agg(F.min(F.struct((-F.col("youden")).alias("v"), (-F.col("threshold")).alias("o"),
                                F.col("threshold"), F.col("tpr"), F.col("fpr"))).alias("b"))
    return best.select("b.threshold", "b.tpr", "b.fpr", (-F.col("b.v")).alias("youden"))


def apply_threshold(scored: DataFrame, threshold: float | Column, score: str = "score",
                    out: str = "prediction") -> DataFrame:
    """D3: prediction = score >= threshold."""
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.withColumn(out, (F.col(score) >= th).cast("int"))


def force_best_match(scored: DataFrame, pred: str = "prediction") -> DataFrame:
    """The highest-scored pair of every argument is predicted positive (ties -> smallest
    key_point_id); other pairs keep their prediction."""
    best = best_match(scored.select("arg_id", "key_point_id", "score")).select(
        "arg_id", "key_point_id", F.lit(1).alias("_best"))
    return (scored.join(best, ["arg_id", "key_point_id"], "left")
            .withColumn(pred, F.when(F.col("_best") == 1, F.lit(1)).otherwise(F.col(pred)))
            .drop("_best"))


def best_match_threshold(scored: DataFrame, label: str = "label", pred: str = "prediction",
                         grid: tuple = BEST_MATCH_GRID) -> DataFrame:
    """For each grid threshold th, predictions = own prediction OR (best pair of its
    argument AND score >= th); the th with the highest F1 (first maximum). Each threshold is
    evaluated on its own (the reference's loop carries flags over between thresholds)."""
    kind, lo, hi, n = grid
    y, p = (F.col(label) == 1).cast("long"), F.col(pred) == 1
    real = F.col("score").isNotNull() & ~F.isnan("score") & F.col("arg_id").isNotNull()
    # one row per argument: its sums, and its best pair (as ``best_match`` picks it) with label and prediction
    each = scored.groupBy("arg_id").agg(
        F.sum(F.when(p, y).otherwise(0)).alias("tp0"), F.count(F.when(p, 1)).alias("pp0"), F.sum(y).alias("P"),
        F.min(F.when(real, F.struct((-F.col("score")).alias("neg"), "key_point_id", y.alias("y"), p.alias("p")))).alias("b"))
    flip = F.col("b").isNotNull() & ~F.col("b.p")
    bucket = F.when(flip, grid_count_at_or_below(-F.col("b.neg"), kind, lo, hi, n)).otherwise(F.lit(-1))
    # at most a row per grid point: both tables below come from it
    per = materialize(each.groupBy(bucket.alias("b")).agg(
        F.sum("tp0").alias("tp0"), F.sum("pp0").alias("pp0"), F.sum("P").alias("P"),
        F.sum(F.when(flip, F.col("b.y")).otherwise(0)).alias("pos"), F.count(F.when(flip, 1)).alias("cnt")), "best-buckets")
    base = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp0", "pp0", "P")])
    flips = per.filter(F.col("b") >= 0).select("b", "pos", "cnt")
    g = grid_grid(scored.sparkSession, kind, lo, hi, n)
    j = _grid_suffix(g, flips, ["pos", "cnt"]).withColumnsRenamed({"pos": "tp1", "cnt": "pp1"})
    j = with_scalars(j, base)
    tp = F.col("tp0") + F.col("tp1")
    pp = F.col("pp0") + F.col("pp1")
    j = j.withColumn("f1", F.coalesce(F.try_divide((2 * tp).cast("double"),
                                                   (pp + F.col("P")).cast("double")), F.lit(0.0)))
    best_t = _first_best(j, "f1", F.col("i"))
    return best_t.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(-1.0))
                         .alias("threshold"), "f1")


def early_stop(history: DataFrame, patience: int = 3, threshold: float = 0.0,
               run: str = "run", epoch: str = "epoch", loss: str = "eval_loss") -> DataFrame:
    """Per run, the epoch at which early stopping fires (``patience`` evaluations in a row
    without beating the best loss so far by more than ``threshold``; the last epoch if it never
    fires) and the best epoch (lowest loss, first on ties) among the epochs run.
    Histories are a few rows per run, so plain windows per run are fine."""
    w_prev = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding,
                                                               Window.currentRow)
    best_before = F.min(loss).over(w_prev)
    h = history.withColumn("_best_before", best_before).withColumn(
        "_improved", F.col("_best_before").isNull()
        | ((F.col(loss) < F.col("_best_before"))
           & (F.abs(F.col(loss) - F.col("_best_before")) > F.lit(float(threshold)))))
    h = h.withColumn("_grp", F.sum(F.col("_improved").cast("int")).over(w_run))
    w_grp = Window.partitionBy(run, "_grp").orderBy(epoch)
    h = h.withColumn("_wait", F.row_number().over(w_grp) - 1)
    stops = h.groupBy(run).agg(
        F.min(F.when(F.col("_wait") >= patience, F.col(epoch))).alias("_stop"),
        F.max(epoch).alias("_last"))
    h = h.join(stops, run).withColumn("stop_epoch", F.coalesce("_stop", "_last"))
    ran = h.filter(F.col(epoch) <= F.col("stop_epoch"))
    return ran.groupBy(run).agg(
        F.first("stop_epoch").alias("stop_epoch"),
        F.min(F.struct(F.col(loss), F.col(epoch))).alias("_b"),
        F.count(F.lit(1)).alias("epochs_run")).select(
        run, "stop_epoch", F.col("_b." + epoch).alias("best_epoch"),
        F.col("_b." + loss).alias("best_loss"), "epochs_run")
