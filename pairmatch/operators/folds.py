"""Dense ids and k-fold assignment.

Keys are enumerated in sorted order (the reference enumerates a Python set, whose order is not
reproducible; ledger L8) with the distributed two-level rank, then folds follow the closed form
of an unshuffled k-fold split (ledger L9): with q = n div k and r = n mod k, the first r folds
hold q + 1 consecutive keys and the rest q.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank
from .sizing import with_scalars


def dense_ids(df: DataFrame, key: str, out: str = "key_id") -> DataFrame:
    """Distinct values of ``key`` numbered 0..n-1 in sorted order."""
    keys = df.select(key).distinct()
    return global_rank(keys, [F.col(key).asc()], out="_r").select(
        key, (F.col("_r") - 1).alias(out))


def kfold_index(i: Column, n: int, k: int) -> Column:
    """Fold of the 0-based key rank ``i`` among ``n`` keys split into ``k`` contiguous folds."""
    if n < k:
        raise ValueError(f"cannot split {n} keys into {k} folds")
    q, r = divmod(n, k)
    big = r * (q + 1)
    return F.when(i < big, F.floor(i / F.lit(q + 1))).otherwise(
        F.lit(r) + F.floor((i - F.lit(big)) / F.lit(q))).cast("int")


def key_folds(df: DataFrame, key: str, num_folds: int, id_col: str = "key_id") -> DataFrame:
    """(key, id, fold) for the distinct keys of ``df``."""
    ids = dense_ids(df, key, id_col)
    n = ids.count()
    return ids.withColumn("fold", kfold_index(F.col(id_col), n, num_folds))


def topic_folds(pairs: DataFrame, num_folds: int = 7) -> DataFrame:
    """F1 (``KFolds.setup_folds``): topics -> (topic, topic_id, fold)."""
    return key_folds(pairs, "topic", num_folds, "topic_id")


def argument_folds(pairs: DataFrame, num_folds: int = 5) -> DataFrame:
    """the same split over arg_ids (high cardinality: the rank is distributed)."""
    return key_folds(pairs, "arg_id", num_folds, "arg_key_id")


def with_folds(pairs: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Attach the fold of each row's key (C13 key -> id lookup)."""
    return pairs.join(folds, key)


def get_fold(pairs_with_fold: DataFrame, fold_id: int) -> tuple[DataFrame, DataFrame]:
    """F2 (``get_fold``): (train rows: other folds, dev rows: this fold)."""
    f = F.col("fold") == fold_id
    return pairs_with_fold.filter(~f), pairs_with_fold.filter(f)


def fold_sizes(pairs_with_fold: DataFrame) -> DataFrame:
    """per fold and role (train / dev), the number of pairs, arguments and topics. A value
    may live in several folds: it is missing from the train side of a fold only if it lives in no
    other, so the train side is counted from each value's smallest and largest fold, without
    materialising the k copies."""
    sizes = pairs_with_fold.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("arg_id").alias("n_arguments"),
        F.count_distinct("topic").alias("n_topics"))
    train = with_scalars(sizes.select("fold", F.col("n_pairs").alias("_own")),
                         pairs_with_fold.agg(F.count(F.lit(1)).alias("_all")))
    train = train.select("fold", (F.col("_all") - F.col("_own")).alias("n_pairs"))
    for col, out in (("arg_id", "n_arguments"), ("topic", "n_topics")):
        spread = (pairs_with_fold.filter(F.col(col).isNotNull()).groupBy(col)
                  .agg(F.min("fold").alias("fold"), F.max("fold").alias("_hi")))
        only = spread.filter(F.col("fold") == F.col("_hi")).groupBy("fold").agg(F.count(F.lit(1)).alias("_only"))
        train = with_scalars(train.join(only, "fold", "left"), spread.agg(F.count(F.lit(1)).alias("_n")))
        train = train.withColumn(out, F.col("_n") - F.coalesce("_only", F.lit(0))).drop("_n", "_only")
    roles = ["n_pairs", "n_arguments", "n_topics"]
    return (sizes.select("fold", F.lit("dev").alias("role"), *roles)
            .unionByName(train.select("fold", F.lit("train").alias("role"), *roles)))
