"""Site-relative line deduplication (operator 10), DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it
divided by the host's pages; a line above ``max_ratio`` (and on at least ``min_pages`` pages) is
boilerplate of that host and is dropped from each of its pages. Pages of one host with equal text
count as one page, in both numbers, so many copies of one article do not turn its lines into
boilerplate.

Plan: (host, page digest, line digest) rows are deduplicated and counted with map-side partial
aggregates, so neither a hot host nor a hot line meets in one task and no text is shuffled. The
boilerplate of a host is one row of digests, of which there are at most the mean number of lines
per page divided by ``max_ratio``; that small table is written to the shared folder, so Spark knows
its size when it plans the join with the pages: a broadcast if it is small, else a sort-merge join
whose hot host AQE splits.

Lines end at \\n and are compared as they are. Blank lines (empty or spaces) are never counted nor
dropped. A null text stays null and counts as a page without lines; rows of a null host form a host
of their own; repeated rows are treated alike; an empty table gives an empty result. Of the input's
other columns only those named in ``carry`` are kept, whatever their names; ``n_lines`` and ``n_dropped`` are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse_clash, stored

MAX_RATIO = 0.05
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def boilerplate(docs: DataFrame, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """``host`` and its boilerplate line digests ``drop``, one row per host that has any."""
    pages = docs.select(F.col(host).alias("host"), F.xxhash64("text").alias("page"), "text")
    lines = pages.select("host", "page", F.explode(F.transform(
        F.array_distinct(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")), _digest)).alias("line"))
    counts = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.select("host", "page").distinct().groupBy(F.col("host").alias("site")).agg(F.count("*").alias("total"))
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).filter(F.col("n") > max_ratio * F.col("total"))
    return over.groupBy("host").agg(F.collect_set("line").alias("drop"))


def site_line_dedup(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO,
                    min_pages: int = MIN_PAGES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ``host``, cleaned ``text``, ``n_lines`` and ``n_dropped`` of every row."""
    own = [c for c in dict.fromkeys((*carry, host)) if c != "text"]
    refuse_clash(own, ("n_lines", "n_dropped"))
    # what is carried travels in a struct: no name in it can meet one used here
    rows = docs.select(F.struct(*own).alias("own"), F.col(host).alias("site"), "text")
    bad = stored(boilerplate(rows, "site", max_ratio, min_pages), "boilerplate")
    kept = F.when(F.col("drop").isNull(), F.col("all")).otherwise(F.filter(
        "all", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _digest(x))))
    out = (rows.join(bad, F.col("site").eqNullSafe(F.col("host")), "left")
           .withColumn("all", _lines(F.col("text"))).withColumn("kept", kept))
    n = F.coalesce(F.size("all"), F.lit(0))
    return out.select(
        *[F.col("own").getField(c).alias(c) for c in own], F.array_join("kept", "\n").alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_dropped"))
