"""Equi-joins on keys that may hold a third of all rows (Zipf tokens, hot topics).

AQE splits a hot partition of the preserved side only, replicating the other side whole, and not at
all below its size thresholds. Two plans that need no luck with sizes:

* ``spread_join``: the right side has one row per key and a bounded head of frequent keys. The head
  meets the left rows by broadcast; what it matched is scattered over all partitions in the shuffle
  join with the tail, so no key of the head gathers anywhere.
* ``grid_join``: both sides may repeat a key. The pairs of a hot key are cut into a grid of cells:
  left rows are dealt to the grid's rows and copied to its columns, right rows the other way round
  (fragment and replicate on both sides). A pair of rows meets in exactly one cell, and a cell holds
  about ``cell`` rows of a side, however hot the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import materialize

HEAD = 256             # keys of a broadcast head
CELL = 1_000_000       # rows of a side in one cell of a grid


def spread_join(left: DataFrame, right: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with column ``value`` of ``right`` (one row per ``key``; null where there is none).
    ``head``: the rows of ``right`` whose keys are frequent in ``left``, at most ``HEAD`` of them (by
    how it was made: it is broadcast). A null key matches nothing and is scattered as well."""
    cols = left.columns
    met = left.join(F.broadcast(head.select(F.col(key).alias("_hk"), F.col(value).alias("_hv"))),
                    F.col(key) == F.col("_hk"), "left")
    done = F.col("_hk").isNotNull() | F.col(key).isNull()
    met = met.select(*cols, "_hv", F.when(~done, F.col(key)).alias("_tk"),
                     F.when(done, F.xxhash64(*[F.col(c) for c in cols])).otherwise(F.lit(0)).alias("_spread"))
    # always 0, but no literal: a constant would be folded into the join's condition, the shuffle would go
    # by ``_tk`` alone, and all rows that the head matched (their ``_tk`` is null) would meet in one task
    zero = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))
    tail = right.select(F.col(key).alias("_tk"), F.col(value).alias("_tv"), zero.alias("_spread"))
    return met.join(tail, ["_tk", "_spread"], "left").select(*cols, F.coalesce("_hv", "_tv").alias(value))


def grid_of(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int = CELL) -> DataFrame:
    """(keys, ``_rows``, ``_cols``) of the keys whose pairs need more than one cell: at most
    (rows of both sides) / ``cell`` of them, since each has over ``cell`` rows on one side."""
    def count(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(out))
    sizes = count(left, "_rows").join(count(right, "_cols"), list(keys))
    return sizes.filter((F.col("_rows") > 1) | (F.col("_cols") > 1))


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", cell: int = CELL) -> DataFrame:
    """``left`` joined to ``right`` on ``keys`` (``inner`` or ``left``), hot keys cut into cells. The
    result is that of ``left.join(right, keys, how)``; null keys match nothing."""
    keys = list(keys)
    if how not in ("inner", "left"):
        raise ValueError("inner and left joins only")
    grid = materialize(grid_of(left, right, keys, cell), "grid")
    # at most (rows of both sides) / cell rows: a proven bound, a few MB for 10^11 rows
    cells = F.broadcast(grid)
    rows, cols = F.coalesce("_rows", F.lit(1)), F.coalesce("_cols", F.lit(1))
    own, other = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]

    def dealt(df: DataFrame, mine, theirs, at: str, copies: str) -> DataFrame:
        # rows alike in all columns go to one cell: fine for ids, and still exact otherwise
        x = df.join(cells, keys, "left").withColumn(at, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), mine.cast("long")))
        return x.select(*df.columns, at, F.explode(F.sequence(F.lit(0).cast("long"), theirs.cast("long") - 1)).alias(copies))

    pairs = dealt(left, rows, cols, "_r", "_c").join(dealt(right, cols, rows, "_c", "_r"), [*keys, "_r", "_c"])
    pairs = pairs.select(*keys, *own, *other)
    if how == "inner":
        return pairs
    lone = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return pairs.unionByName(lone, allowMissingColumns=True)
