"""Evaluation aggregates: classification metrics, ROC AUC, precision/recall curve, retrieval
average precision and its mean, losses (A1-A8, A21-A23, W2, W3).

Everything is a grouped aggregate (``group_cols`` may be empty). Curves and AUC first collapse
rows to one row per distinct score, then take running sums with the two-level prefix sum, so
no group ever has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import bce_with_logits, two_class_nll
from .matching import DUMMY_ID
from .ranking import prefix_sums, rank_within
from .sizing import join_groups, materialize, with_scalars

METRIC_NAMES = ["acc_neg", "acc_pos", "acc", "prec", "recall", "f1_pos", "f1", "auc"]


def _grouped(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Group columns to use, with a constant group for whole-table metrics so that per-group
    side tables always join on a key."""
    g = list(group_cols)
    if g:
        return df, g, g
    return df.withColumn("_all", F.lit(0)), ["_all"], []


def _safe_ratio(num, den):
    return F.try_divide(num.cast("double"), den.cast("double"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """tp / fp / fn / tn per group, one pass (P9 class split as conditional counts)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*group_cols).agg(
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p != 1), 1)).alias("fn"),
        F.count(F.when((y == 0) & (p != 1), 1)).alias("tn"))


def _per_score(df: DataFrame, g: list[str], label: str, score: str,
               pred: str | None = None) -> DataFrame:
    """One scan of the input: per (group, distinct score) positives / negatives, and the
    confusion counts of ``pred`` when given."""
    y = F.col(label)
    aggs = [F.count(F.when(y == 1, 1)).alias("_pos"), F.count(F.when(y == 0, 1)).alias("_neg")]
    if pred is not None:
        p = F.col(pred)
        aggs += [F.count(F.when((y == 1) & (p == 1), 1)).alias("_tp"),
                 F.count(F.when((y == 0) & (p == 1), 1)).alias("_fp"),
                 F.count(F.when((y == 1) & (p != 1), 1)).alias("_fn"),
                 F.count(F.when((y == 0) & (p != 1), 1)).alias("_tn")]
    return df.groupBy(*g, score).agg(*aggs)


def _auc_from_cum(cum: DataFrame, g: list[str]) -> DataFrame:
    below = F.col("cum__neg") - F.col("_neg")
    return cum.groupBy(*g).agg(
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"),
        F.sum(F.col("_pos") * (below + F.col("_neg") * F.lit(0.5))).alias("_S")
    ).select(*g, _safe_ratio(F.col("_S"), F.col("_P") * F.col("_N")).alias("auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            group_cols: Sequence[str] = ()) -> DataFrame:
    """A4: ROC AUC with ties counted half: sum over distinct scores s of
    pos(s) * (negatives below s + neg(s) / 2) / (P * N). Null with a single class."""
    g = list(group_cols)
    cum = prefix_sums(_per_score(df, g, label, score), g, [F.col(score).asc()], ["_neg"])
    return _auc_from_cum(cum, g)


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                   score: str = "score", group_cols: Sequence[str] = (),
                   suffix: str = "") -> DataFrame:
    """A1-A4 (``evaluate``): acc_neg, acc_pos, acc, prec, recall, f1_pos, f1, auc per group.
    Empty-denominator precision / recall / F1 are 0; accuracy of an empty class and AUC with
    one class are null (ledger L20). The input is scanned once: confusion counts and the AUC
    both come from the materialised per-score table."""
    df, g, keep = _grouped(df, group_cols)
    cum = prefix_sums(_per_score(df, g, label, score, pred), g, [F.col(score).asc()], ["_neg"])
    # a whole-table metric is one row, also when the table is empty
    conf = cum.groupBy(*keep).agg(*[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    m = conf.select(
        *keep,
        _safe_ratio(tn, tn + fp).alias("acc_neg"),
        _safe_ratio(tp, tp + fn).alias("acc_pos"),
        _safe_ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
        F.coalesce(_safe_ratio(tp, tp + fp), zero).alias("prec"),
        F.coalesce(_safe_ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(_safe_ratio(2 * tp, 2 * tp + fn), zero).alias("f1_pos"),
        F.coalesce(_safe_ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"))
    auc = _auc_from_cum(cum, keep)
    m = (join_groups(m, auc, keep, how="left") if keep else with_scalars(m, auc)).select(*keep, *METRIC_NAMES)
    if suffix:
        m = m.withColumnsRenamed({n: f"{n}{suffix}" for n in METRIC_NAMES})
    return m


def classified_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                       score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """The reduced set logged per validation epoch."""
    m = binary_metrics(df, label, pred, score, group_cols)
    return m.select(*group_cols, F.col("acc_neg").alias("neg_acc"),
                    F.col("acc_pos").alias("pos_acc"), F.col("acc").alias("all_acc"),
                    F.col("f1").alias("all_f1"), F.col("auc").alias("all_auc"))


def precision_recall_curve(df: DataFrame, label: str = "label", score: str = "score",
                           group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score threshold (descending), cumulative tp / fp and the
    precision / recall of predicting 1 at score >= threshold."""
    df, g, keep = _grouped(df, group_cols)
    per_score = df.groupBy(*g, score).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("_pos"),
        F.count(F.when(F.col(label) != 1, 1)).alias("_neg"))
    cum = prefix_sums(per_score, g, [F.col(score).desc()], ["_pos", "_neg"])
    totals = cum.groupBy(*g).agg(F.sum("_pos").alias("_P"))
    cum = join_groups(cum, totals, g)
    return cum.select(
        *keep, F.col(score).alias("threshold"),
        F.col("cum__pos").alias("tp"), F.col("cum__neg").alias("fp"),
        _safe_ratio(F.col("cum__pos"), F.col("cum__pos") + F.col("cum__neg")).alias("precision"),
        _safe_ratio(F.col("cum__pos"), F.col("_P")).alias("recall"))


def ranked_in_groups(df: DataFrame, group_cols: Sequence[str], fraction: float = 0.5,
                     score: str = "score", tiebreak: str = "arg_id") -> DataFrame:
    """Every row with its rank by score descending (ties by ``tiebreak``) inside its group,
    plus n_group and n_top = int(n_group * fraction). Group sizes are counted on the
    materialised ranked table, so the input plan runs once."""
    g = list(group_cols)
    ranked = rank_within(df, g, [F.col(score).desc(), F.col(tiebreak).asc()])
    counts = ranked.groupBy(*g).agg(F.count(F.lit(1)).alias("n_group")).withColumn(
        "n_top", F.floor(F.col("n_group") * F.lit(float(fraction))).cast("long"))
    return join_groups(ranked, counts, g)


def top_fraction(df: DataFrame, group_cols: Sequence[str], fraction: float = 0.5,
                 score: str = "score", tiebreak: str = "arg_id") -> DataFrame:
    """Per group the first int(n * fraction) rows by score descending (ties by
    ``tiebreak`` ascending, ledger L15). Adds n_group, n_top and rank."""
    return (ranked_in_groups(df, group_cols, fraction, score, tiebreak)
            .filter(F.col("rank") <= F.col("n_top")))


def group_average_precision(matched: DataFrame,
                            label_cols: Sequence[str] = ("label_strict", "label_relaxed"),
                            group_cols: Sequence[str] = ("topic", "stance"),
                            fraction: float = 0.5, dummy_score: float = 0.99) -> DataFrame:
    """A7 (``get_ap``) for several label columns in one pass. Per group: keep the top
    int(n * fraction) rows by score (ties by arg_id), give dummy rows ``dummy_score``, then
    AP * positives / n_top, which in closed form is
    sum over distinct scores s of pos(s) * tp(s) / n(s), divided by n_top.
    A group with n_top = 0 gets null (left out of the mean); no positives gives 0.

    One running sum over rows in (score desc, arg_id) order gives the rank and, at every
    row, the positives and dummies so far. Dummies carry label 0, so moving them to
    ``dummy_score`` after the cut only adds their count to n(s) for real scores s <= that
    score: n(s) = real rows scoring >= s + dummies in the top when s <= dummy_score."""
    g, labels = list(group_cols), list(label_cols)
    x = matched.select(*g, "arg_id", "score", F.lit(1).alias("_one"),
                       (F.col("key_point_id") == DUMMY_ID).cast("int").alias("_dummy"),
                       *[F.col(c).cast("long").alias(c) for c in labels])
    # read by four aggregates: written once, so that the window runs once
    cum = materialize(prefix_sums(x, g, [F.col("score").desc(), F.col("arg_id").asc()],
                                  ["_one", "_dummy", *labels]), "running-sums")
    counts = cum.groupBy(*g).agg(F.count(F.lit(1)).alias("n_group")).withColumn(
        "n_top", F.floor(F.col("n_group") * F.lit(float(fraction))).cast("long"))
    top = join_groups(cum, counts, g).filter(F.col("cum__one") <= F.col("n_top"))
    dummies = top.groupBy(*g).agg(F.sum("_dummy").alias("_nd"))
    per = top.filter(F.col("_dummy") == 0).groupBy(*g, "score").agg(
        F.max(F.col("cum__one") - F.col("cum__dummy")).alias("_n_real"),
        *[F.sum(c).alias(f"_p_{c}") for c in labels],
        *[F.max(f"cum_{c}").alias(f"_tp_{c}") for c in labels])
    per = join_groups(per, dummies, g)
    n_s = F.col("_n_real") + F.when(F.col("score") <= F.lit(float(dummy_score)),
                                    F.col("_nd")).otherwise(F.lit(0))
    sums = per.groupBy(*g).agg(*[
        F.sum(F.col(f"_p_{c}") * F.col(f"_tp_{c}") / n_s).alias(f"_s_{c}") for c in labels])
    out = join_groups(counts, sums, g, how="left")
    return out.select(*g, "n_group", "n_top", *[
        F.when(F.col("n_top") == 0, F.lit(None).cast("double"))
        .otherwise(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) / F.col("n_top"))
        .alias(f"ap_{c.replace('label_', '')}") for c in labels])


def mean_average_precision(matched: DataFrame, **kw) -> DataFrame:
    """Unweighted mean of the per-group AP (nulls left out): mAP_strict, mAP_relaxed."""
    ap = group_average_precision(matched, **kw)
    cols = [c for c in ap.columns if c.startswith("ap_")]
    return ap.agg(*[F.avg(c).alias(f"mAP_{c[3:]}") for c in cols])


def weighted_loss(l0: str, l1: str, label: str, class_weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    """A21 as an aggregate column: several weightings fit into one pass."""
    w = F.when(F.col(label) == 1, F.lit(float(class_weights[1]))).otherwise(F.lit(float(class_weights[0])))
    return F.sum(w * two_class_nll(l0, l1, label)) / F.sum(w)


def bce_loss(x: str, label: str, pos_weight: float = 1.0) -> Column:
    """A22 as an aggregate column."""
    return F.avg(bce_with_logits(x, label, pos_weight))


def weighted_log_loss(df: DataFrame, l0: str, l1: str, label: str,
                      class_weights: tuple[float, float] = (1.0, 1.0),
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Class-weighted cross-entropy, sum(w * nll) / sum(w)."""
    return df.groupBy(*group_cols).agg(weighted_loss(l0, l1, label, class_weights).alias("loss"))


def bce_log_loss(df: DataFrame, x: str, label: str, pos_weight: float = 1.0,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean BCE-with-logits with a positive-class weight."""
    return df.groupBy(*group_cols).agg(bce_loss(x, label, pos_weight).alias("loss"))


def batch_mean_loss(df: DataFrame, loss: str, batch_col: str,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Epoch loss = mean of the per-batch mean losses (not the mean over rows)."""
    per_batch = df.groupBy(*group_cols, batch_col).agg(F.avg(loss).alias("_b"))
    return per_batch.groupBy(*group_cols).agg(F.avg("_b").alias("loss"),
                                              F.count(F.lit(1)).alias("n_batches"))
