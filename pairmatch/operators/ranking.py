"""Total-order operators without a single-task window.

``Window.partitionBy(g).orderBy(...)`` puts a whole group into one task; with a handful of
(topic, stance) groups, or no group at all (AUC, batch numbering, argument folds), that task
would hold a third of the data or all of it. Instead:

1. ``orderBy(group, keys)`` -- Spark's distributed range-partitioned sort -- then
   ``monotonically_increasing_id`` gives every row (partition index, position) in sort order;
2. the result is written once as parquet to the shared checkpoint folder and read back, so
   the ids are fixed even if an executor is lost and a partition is recomputed (the ids are a
   column: nothing downstream depends on physical partitions);
3. per (partition, group) counts / sums are a tiny table (at most partitions + groups rows);
   a window over it gives each partition's offset within its group, which is joined back on
   (partition, group), null groups included;
4. rank = offset + position inside the partition; running sums = offset + a window running
   sum inside (partition, group), which is bounded by one partition.

The sort keys must make the order total inside each group (append a unique id) or ranks of
tied rows depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .sizing import join_groups

_RID = "_pm_rid"
_PID = "_pm_pid"
_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | row position


def _ordered(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    ordered = (df.orderBy(*[F.col(c) for c in group_cols], *order)
               .withColumn(_RID, F.monotonically_increasing_id()))
    ordered.write.mode("overwrite").parquet(path)
    return (spark.read.schema(ordered.schema).parquet(path)
            .withColumn(_PID, F.shiftright(F.col(_RID), _POS_BITS)))


def _group_window(group_cols: Sequence[str]):
    w = Window.partitionBy(*group_cols) if group_cols else Window
    return w.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)


def rank_within(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                out: str = "rank") -> DataFrame:
    """1-based row number of every row inside its group under ``order`` (a total order)."""
    group_cols = list(group_cols)
    ck = _ordered(df, group_cols, order)
    stats = ck.groupBy(_PID, *group_cols).agg(F.count(F.lit(1)).alias("_n"),
                                              F.min(_RID).alias("_first"))
    offs = stats.select(_PID, *group_cols, "_first",
                        F.coalesce(F.sum("_n").over(_group_window(group_cols)),
                                   F.lit(0)).alias("_off"))
    return (join_groups(ck, offs, group_cols, [_PID])
            .withColumn(out, (F.col("_off") + F.col(_RID) - F.col("_first") + 1).cast("long"))
            .drop(_PID, _RID, "_first", "_off"))


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                sum_cols: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` inside each group under ``order``; adds
    ``{prefix}{col}`` per column.

    The offsets are joined on (partition id, group) as a shuffle join: the running-sum window
    needs exactly that clustering, so the join and the window share one exchange of the ranked
    rows (each key holds at most one sort partition)."""
    group_cols, sum_cols = list(group_cols), list(sum_cols)
    ck = _ordered(df, group_cols, order)
    totals = ck.groupBy(_PID, *group_cols).agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    gw = _group_window(group_cols)
    offs = totals.select(_PID, *group_cols,
                         *[F.coalesce(F.sum(f"_t_{c}").over(gw), F.lit(0)).alias(f"_o_{c}")
                           for c in sum_cols])
    keyed = join_groups(ck, offs, group_cols, [_PID])
    lw = (Window.partitionBy(_PID, *group_cols).orderBy(_RID)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    res = keyed.select("*", *[(F.col(f"_o_{c}") + F.sum(c).over(lw)).alias(f"{prefix}{c}")
                              for c in sum_cols])
    return res.drop(_PID, _RID, *[f"_o_{c}" for c in sum_cols])


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based position of every row under a total order over the whole table."""
    return rank_within(df, [], order, out)
