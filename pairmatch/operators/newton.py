"""Logistic regression by Newton steps written as grouped aggregates (M1, M2, M4).

Each step is one pass over a stored table of dense features: the gradient and the upper triangle of
the Hessian are sums that combine map-side, so what moves is one row per task and model, and what
reaches the driver is d + d (d + 1) / 2 numbers per model. The d x d system is solved there.

k cross-validation models cost one pass as well: the k weight vectors are literals, every row meets
those it trains (all but the model of its own fold), and the sums are grouped by model. The number of
steps is fixed, so a fit takes the same jobs whatever the data, and SQL can recompute it.

The objective is Spark ML's: weighted mean log loss + reg / 2 * |w|^2 without the intercept. A null
feature counts as 0, a row without a label does not train, a table without rows leaves all weights 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .sizing import materialize, spread_pairs

INTERCEPT = "intercept"
FEATURES = ("n_shared", "jaccard", "log_len_a", "log_len_b")
STEPS = 8
REG = 0.01
ALL = -1          # the fold of rows that train every model


def overlap_features(pairs: DataFrame, arguments: DataFrame, key_points: DataFrame) -> DataFrame:
    """The dense features of each pair (``arg_id``, ``key_point_id`` and its other columns): distinct
    words shared, their Jaccard ratio, log of the distinct words of each side. Texts are tokenised
    once, in their own tables; a pair carries no text and no token."""
    aw = arguments.select("arg_id", F.array_distinct(words("argument")).alias("_wa"))
    kw = key_points.select("key_point_id", F.array_distinct(words("key_point")).alias("_wb"))
    x = spread_pairs(pairs).join(aw, "arg_id").join(kw, "key_point_id")
    x = x.select(*pairs.columns, F.size("_wa").cast("double").alias("_na"), F.size("_wb").cast("double").alias("_nb"),
                 F.size(F.array_intersect("_wa", "_wb")).cast("double").alias("n_shared"))
    union = F.col("_na") + F.col("_nb") - F.col("n_shared")
    return x.select(*pairs.columns, "n_shared", F.coalesce(F.try_divide(F.col("n_shared"), union), F.lit(0.0)).alias("jaccard"),
                    F.log1p("_na").alias("log_len_a"), F.log1p("_nb").alias("log_len_b"))


def margin(weights: Sequence[float], features: Sequence[str] = FEATURES) -> Column:
    """Intercept plus weighted features."""
    out = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features):
        out = out + F.lit(float(w)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return out


def _models(weights: np.ndarray) -> Column:
    """The models as an array of literals: (model, w0, w1, ...)."""
    return F.array(*[F.struct(F.lit(m).alias("model"), *[F.lit(float(w)).alias(f"w{i}") for i, w in enumerate(row)])
                     for m, row in enumerate(weights)])


def _sums(rows: DataFrame, weights: np.ndarray) -> list:
    """Gradient, Hessian and total weight of every model, one pass over ``rows`` (fold, y, c, x1, ...)."""
    d = weights.shape[1]
    x = ["x0", *[f"x{i}" for i in range(1, d)]]
    met = (rows.select("*", F.lit(1.0).alias("x0"), F.explode(_models(weights)).alias("m"))
           .filter(F.col("fold") != F.col("m.model")))
    z = F.lit(0.0)
    for i in range(d):
        z = z + F.col(f"m.w{i}") * F.col(x[i])
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    # projected below the aggregate: evaluated once per row, not once per sum
    met = met.select(F.col("m.model").alias("model"), "c", *x, p.alias("p"), "y").select(
        "model", "c", *x, (F.col("c") * (F.col("y") - F.col("p"))).alias("r"),
        (F.col("c") * F.col("p") * (F.lit(1.0) - F.col("p"))).alias("h"))
    return met.groupBy("model").agg(
        F.sum("c").alias("c"), *[F.sum(F.col("r") * F.col(x[i])).alias(f"g{i}") for i in range(d)],
        *[F.sum(F.col("h") * F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]).collect()


def _step(weights: np.ndarray, sums: list, reg: float) -> np.ndarray:
    d = weights.shape[1]
    out = weights.copy()
    for s in sums:
        w = weights[s.model]
        ridge = reg * s.c * np.array([0.0] + [1.0] * (d - 1))
        g = np.array([s[f"g{i}"] for i in range(d)]) - ridge * w
        h = np.diag(ridge)
        for i in range(d):
            for j in range(i, d):
                h[i, j] += s[f"h{i}_{j}"]
                h[j, i] = h[i, j]
        out[s.model] = w + np.linalg.lstsq(h, g, rcond=None)[0]
    return out


def fit_folds(rows: DataFrame, num_folds: int, features: Sequence[str] = FEATURES, pos_weight: float = 1.0,
              steps: int = STEPS, reg: float = REG) -> list[list[float]]:
    """M4: the weights (intercept first) of ``num_folds`` models, model f trained on the rows of
    every ``fold`` but f. ``rows``: the features, ``label`` and ``fold``."""
    data = materialize(rows.filter(F.col("label").isNotNull()).select(
        F.col("fold").cast("int").alias("fold"), F.col("label").cast("double").alias("y"),
        F.when(F.col("label") == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)).alias("c"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i + 1}") for i, f in enumerate(features)]), "newton-rows")
    weights = np.zeros((num_folds, len(features) + 1))
    for _ in range(steps):
        weights = _step(weights, _sums(data, weights), reg)
    return weights.tolist()


def fit(rows: DataFrame, features: Sequence[str] = FEATURES, pos_weight: float = 1.0, steps: int = STEPS,
        reg: float = REG) -> list[float]:
    """M1 + M2: the weights (intercept first) of one model on all labelled ``rows``."""
    return fit_folds(rows.withColumn("fold", F.lit(ALL)), 1, features, pos_weight, steps, reg)[0]


def weights_frame(rows: DataFrame, weights: Sequence[float], features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, weight) of a fitted model, a row each."""
    return rows.sparkSession.createDataFrame(list(zip([INTERCEPT, *features], map(float, weights))), "feature string, weight double")


def score(features_: DataFrame, weights: Sequence[float], features: Sequence[str] = FEATURES,
          keep: Sequence[str] = ("arg_id", "key_point_id")) -> DataFrame:
    """M3: ``l0`` = 0, ``l1`` = margin, ``score`` = P(label 1), ``prediction``."""
    return (features_.select(*keep, F.lit(0.0).alias("l0"), margin(weights, features).alias("l1"))
            .withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("l1"))))
            .withColumn("prediction", (F.col("l1") > 0).cast("int")))


def score_folds(features_: DataFrame, weights: Sequence[Sequence[float]], features: Sequence[str] = FEATURES,
                keep: Sequence[str] = ("arg_id", "key_point_id")) -> DataFrame:
    """Every model's scores in one long table with a ``fold`` column, ready for ``ensemble_scores``:
    the margins of a row are one array, exploded with its positions."""
    margins = F.array(*[margin(w, features) for w in weights])
    return (features_.select(*keep, F.posexplode(margins).alias("fold", "logit"))
            .select(*keep, F.col("fold").cast("int").alias("fold"), "logit",
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))).alias("score"),
                    (F.col("logit") > 0).cast("int").alias("prediction")))
