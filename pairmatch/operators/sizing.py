"""One-row joins, null-safe group joins and materialisation.

No join is hinted here: Spark broadcasts a side by its own size estimate or, at run time, by its
measured size (thresholds in ``session.DEFAULT_CONF``), and plans a shuffle join beyond it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def join_groups(left: DataFrame, right: DataFrame, group_cols: Sequence[str], keys: Sequence[str] = (),
                how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``group_cols`` (a null group matches a
    null group) and on ``keys`` (plain equality)."""
    cols = [*keys, *group_cols]
    r = right.withColumnsRenamed({c: f"_g_{c}" for c in cols})
    on = None
    for c in cols:
        same = (F.col(c) == F.col(f"_g_{c}")) if c in keys else F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        on = same if on is None else on & same
    return left.join(r, on, how).drop(*[f"_g_{c}" for c in cols])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row) to every row of ``df``.
    The aggregate becomes one scalar subquery returning a struct: it runs once, its single
    value is inlined into the projection, and no join (nor any shuffle of ``df``) is planned."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_pm_s")).scalar()
    return df.select("*", packed.alias("_pm_s")).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("_pm_s")[c].alias(c) for c in cols])


def materialize(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` once as parquet to the shared checkpoint folder and read it back: a table
    used by several branches of a plan (a vocabulary, a ranked table) is computed once, and
    its lineage is cut, so a lost executor re-reads files instead of recomputing upstream.
    With ``rows_per_file`` its files hold at most so many rows each (see ``file_per_task``)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def file_per_task(spark: SparkSession) -> Iterator[None]:
    """While a job is planned: a task reads one file. Spark packs files by their size on disk, and files
    that compress a hundredfold would unpack to gigabytes in one task."""
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, spark.conf.get(cost))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` dealt evenly over the session's shuffle partitions. Pairs come out of joins in the
    partitions of whatever table was scanned; dealing the ids, before any text or feature is joined,
    lets the work per pair (and every pass of a fit over the result) use all cores."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "arg_id", "key_point_id")
