"""Score expressions over classifier logits (C9-C12, A21/A22 row losses)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def positive_softmax(l0, l1) -> Column:
    """Softmax over the two logits, probability of class 1: 1 / (1 + exp(l0 - l1))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(l0) - _c(l1)))


def argmax_class(l0, l1) -> Column:
    """C11: index of the larger logit; a tie gives class 0 (numpy argmax)."""
    return (_c(l1) > _c(l0)).cast("int")


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def threshold_class(x, threshold: float = 0.5) -> Column:
    """sigmoid(x) >= threshold (inclusive) as 0/1."""
    return (sigmoid(x) >= F.lit(threshold)).cast("int")


def softplus(x) -> Column:
    """log(1 + exp(x)) without overflow."""
    c = _c(x)
    return F.log1p(F.exp(-F.abs(c))) + F.greatest(c, F.lit(0.0))


def two_class_nll(l0, l1, label) -> Column:
    """Row cross-entropy of a 2-logit classifier: logsumexp(l0, l1) - l_label."""
    a, b = _c(l0), _c(l1)
    m = F.greatest(a, b)
    lse = m + F.log(F.exp(a - m) + F.exp(b - m))
    return lse - F.when(_c(label) == 1, b).otherwise(a)


def bce_with_logits(x, label, pos_weight: float = 1.0) -> Column:
    """Row BCE-with-logits: -(pw*y*log(sigmoid(x)) + (1-y)*log(1-sigmoid(x)))."""
    y = _c(label).cast("double")
    return F.lit(float(pos_weight)) * y * softplus(-_c(x)) + (F.lit(1.0) - y) * softplus(_c(x))


def batch_then_row_softmax(df: DataFrame, l0: str, l1: str, batch_col: str,
                           out: str = "score") -> DataFrame:
    """C10 (ledger L5): softmax over *all* logits of a batch, then a row softmax of the two
    resulting probabilities. Batches are small (64 rows), so the window per batch is cheap."""
    w = Window.partitionBy(batch_col)
    m = F.max(F.greatest(F.col(l0), F.col(l1))).over(w)
    e0 = F.exp(F.col(l0) - m)
    e1 = F.exp(F.col(l1) - m)
    z = F.sum(e0 + e1).over(w)
    return df.withColumn(out, positive_softmax(e0 / z, e1 / z))
