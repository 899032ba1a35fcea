"""Pair tables: labelled pairs, candidate generation, membership filters, sampling, unions
(J1-J4, P1, P3, P4, T4, U1-U3, E1, E2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, extra_segments, topic_id
from ..sources.schemas import PAIR_COLS
from .sizing import materialize
from .skew import grid_join


def labelled_pairs(arguments: DataFrame, key_points: DataFrame, labels: DataFrame) -> DataFrame:
    """J1+J2 (``generate_combined_df``): labels inner-join arguments on arg_id, then key points
    (trimmed to id + text) on key_point_id; canonical 7-column order (P1). Extra columns of the
    inputs such as ``subset`` are carried from the labels side."""
    extra = [c for c in labels.columns if c not in ("arg_id", "key_point_id", "label")]
    args = arguments.select("arg_id", "argument", "topic", "stance")
    kps = key_points.select("key_point_id", "key_point")
    return (labels.join(args, "arg_id")
            .join(kps, "key_point_id")
            .select(*PAIR_COLS, *extra))


SIDE = ["topic", "stance", "topic_id"]


def candidate_ids(arguments: DataFrame, key_points: DataFrame, cell: int | None = None) -> DataFrame:
    """J3 on ids only: every argument left-joined to the key points of the same topic, stance
    and topic id; arguments without a key point keep one row with a null key point. Texts are
    not carried: the explosion (arguments x key points per side) stays narrow.

    A task has a few dozen sides. While the key points are few, Spark broadcasts them and no side is
    hot. Where both tables are large, ``cell`` cuts the pairs of a side into cells of that many rows
    of either table (``skew.grid_join``): same rows, spread over the cluster."""
    a = arguments.select("arg_id", "topic", "stance", topic_id("arg_id").alias("topic_id"))
    k = key_points.select("key_point_id", "topic", "stance", topic_id("key_point_id").alias("topic_id"))
    joined = a.join(k, SIDE, "left") if cell is None else grid_join(a, k, SIDE, "left", cell)
    return joined.select("arg_id", "key_point_id", "topic", "stance")


def candidate_pairs(arguments: DataFrame, key_points: DataFrame,
                    labels: DataFrame | None = None) -> DataFrame:
    """J3 + J4 (``_generate_combined_df_test``): candidate pairs with texts, gold label attached
    by a left join on (arg_id, key_point_id) when labels are given (null without gold)."""
    if labels is None:
        # the texts are wanted and nothing is looked up by id: one scan of the arguments
        a = arguments.select("arg_id", "argument", "topic", "stance", topic_id("arg_id").alias("topic_id"))
        k = key_points.select("key_point_id", "key_point", "topic", "stance", topic_id("key_point_id").alias("topic_id"))
        return (a.join(k, ["topic", "stance", "topic_id"], "left")
                .withColumn("label", F.lit(None).cast("int")).select(*PAIR_COLS))
    ids = candidate_ids(arguments, key_points).join(
        labels.select("arg_id", "key_point_id", "label"), ["arg_id", "key_point_id"], "left")
    args = arguments.select("arg_id", "argument")
    kps = key_points.select("key_point_id", "key_point")
    return (ids.join(args, "arg_id")
            .join(kps, "key_point_id", "left")
            .select(*PAIR_COLS))


def split_known(submitted: DataFrame, key_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key point is known, each unknown key point id once)."""
    known = key_points.select("key_point_id").distinct()
    valid = submitted.join(known, "key_point_id", "left_semi")
    invalid = (submitted.select("key_point_id")
               .join(known, "key_point_id", "left_anti").distinct())
    return valid, invalid


def sample_arguments(pairs: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """T4: keep all pairs of int(n * ratio) distinct arguments chosen without replacement.
    The choice is reproducible and engine-independent: arguments ordered by
    md5(seed | arg_id), first k kept. No table is sorted for it (``smallest``)."""
    if ratio >= 1.0:
        return pairs
    ids = materialize(pairs.select("arg_id").filter(F.col("arg_id").isNotNull()).distinct().withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("arg_id")))), "sample-ids")
    chosen = smallest(ids, "_h", "arg_id", int(ids.count() * ratio)).select("arg_id")
    return pairs.join(chosen, "arg_id", "left_semi")


PREFIX = 4     # hex digits of a hash that number its bucket


def smallest(rows: DataFrame, digest: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of smallest (``digest``, ``key``), without sorting the table. Hex digests are
    spread evenly, so a histogram of their first digits (65,536 counts) tells the bucket in which the
    k-th row lies: buckets before it are taken whole, and only that one is put in order. Stored or
    otherwise repeatable ``rows`` are read twice; rows without a digest are not taken."""
    prefix = F.substring(digest, 1, PREFIX)
    rows = rows.filter(F.col(digest).isNotNull())
    counts = rows.groupBy(prefix.alias("p")).count().collect()       # at most 16 ** PREFIX rows
    taken, cut = 0, None
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        if taken + n > k:
            cut = p
            break
        taken += n
    if cut is None:
        return rows
    last = (rows.filter(prefix == cut).withColumn("_rn", F.row_number().over(Window.orderBy(digest, key)))
            .filter(F.col("_rn") <= k - taken).drop("_rn"))
    return rows.filter(prefix < cut).unionByName(last)


def fit_pairs(train: DataFrame, dev: DataFrame, dedupe: bool = True) -> DataFrame:
    """Train union dev; with ``dedupe`` full-row duplicates are removed."""
    u = train.unionByName(dev)
    return u.dropDuplicates() if dedupe else u


def pair_text(pairs: DataFrame) -> DataFrame:
    """Cleaned argument and key point of each pair."""
    return pairs.withColumn("argument_clean", clean_text("argument")).withColumn(
        "key_point_clean", clean_text("key_point"))


def pair_text_by_key(pair_keys: DataFrame, arguments: DataFrame, key_points: DataFrame) -> DataFrame:
    """E1 with each text cleaned once: arguments and key points are cleaned in their own
    tables and joined to the pair keys, instead of cleaning
    the argument again on every pair row. Carries the other columns of ``pair_keys``."""
    a = arguments.select("arg_id", clean_text("argument").alias("argument_clean"))
    k = key_points.select("key_point_id", clean_text("key_point").alias("key_point_clean"))
    return pair_keys.join(a, "arg_id").join(k, "key_point_id")


def pair_text_topic_stance(pair_keys: DataFrame, arguments: DataFrame, key_points: DataFrame) -> DataFrame:
    """E2 (add_info='topic,stance') on pair ids: ``topic_segment`` is made per argument and travels
    with its id, so no join is keyed by the few topics. Arguments without topic or stance have no
    segment and no pairs here."""
    segment = F.element_at(extra_segments(topic="topic", stance="stance"), 1)
    a = arguments.filter(F.col("topic").isNotNull() & F.col("stance").isNotNull())
    keys = pair_keys.join(a.select("arg_id", segment.alias("topic_segment")), "arg_id")
    return pair_text_by_key(keys, arguments, key_points)


def pair_segments(pairs: DataFrame, add_info: str | None = None) -> DataFrame:
    """Cleaned pair plus the extra segments named in ``add_info`` (comma list, e.g.
    'topic,stance'), as ``segments`` array<string>. Unlike the reference (ledger L6) the
    stance phrase is added on every row."""
    info = [s.strip() for s in add_info.split(",")] if add_info else []
    has_stance = "stance" in info
    others = tuple(c for c in info if c not in ("topic", "stance"))
    seg = extra_segments(topic="topic" if "topic" in info else None,
                         stance="stance" if has_stance else None, others=others)
    return pair_text(pairs).withColumn("segments", seg)
