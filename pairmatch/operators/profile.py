"""Corpus profiling (A10-A18, A24): the exploration notebook's numbers as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count, words
from .sizing import materialize, with_scalars

NUM_BINS = 10


def digested(texts: DataFrame, col: str) -> DataFrame:
    """``texts`` with ``col`` replaced by its digest: joins made on the result move no text, and each
    text is read and digested once, not once per pair."""
    return texts.withColumn(col, F.sha2(col, 256))


def corpus_profile(pairs: DataFrame, cols: list[str] | None = None,
                   texts: Sequence[str] = ("argument", "key_point")) -> DataFrame:
    """A10 + A11 + A24: rows, distinct topics / arguments / key points, duplicate flags
    (distinct != rows, as the notebook tests them) and non-null counts per column. ``texts`` are
    counted by their digests: no text is shuffled. Pairs joined from ``digested`` tables need none."""
    cols = cols or list(pairs.columns)
    pairs = pairs.select(*[F.sha2(c, 256).alias(c) if c in texts else F.col(c) for c in pairs.columns])
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("topic").alias("n_topics"),
        F.count_distinct("argument").alias("n_arguments"),
        F.count_distinct("key_point_id").alias("n_key_points"),
        F.count_distinct("key_point").alias("n_key_point_texts"),
        *[F.count(c).alias(f"nonnull_{c}") for c in cols],
    ).select("*",
             (F.col("n_arguments") != F.col("n_rows")).alias("dup_argument"),
             (F.col("n_key_point_texts") != F.col("n_rows")).alias("dup_key_point"),
             (F.col("n_topics") != F.col("n_rows")).alias("dup_topic"))


def frame_info(df: DataFrame) -> DataFrame:
    """A row per column: its place, name, non-null count and type. One aggregate."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name"), F.col(f"c{i}").alias("non_null"),
                              F.lit(t).alias("dtype")) for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(rows))


# ---------------------------------------------------------------- mergeable profile

LG_K = 12     # a sketch has 2 ** LG_K registers: a few KB, whatever it counted


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error that an estimate stays below (three standard deviations: in 99.7 % of cases)."""
    return deviations * 1.04 / (2 ** lg_k) ** 0.5


def sketch_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """A profile that can be added to (A10 / A11 without re-reading old rows): per group ``by`` the
    row count and, per column, the non-null count and a distinct-count sketch. A sketch is built
    map-side and has a fixed size, so a hot group or a column of unique texts costs no more than
    another; nothing is expanded as several exact distinct counts are."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"nonnull_{c}"), F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"sketch_{c}")]
    return df.groupBy(*by).agg(*aggs)


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles united over all groups but ``by``: subsets into the whole, old rows with new ones.
    The sketch of a union is the union of the sketches."""
    aggs = [F.sum(c).alias(c) if not c.startswith("sketch_") else F.hll_union_agg(c).alias(c)
            for c in profiles.columns if c == "n_rows" or c.startswith(("nonnull_", "sketch_"))]
    return profiles.groupBy(*by).agg(*aggs)


def profile_estimates(profiles: DataFrame) -> DataFrame:
    """Each sketch replaced by its distinct count ``distinct_<column>`` (estimated)."""
    return profiles.select(*[F.hll_sketch_estimate(c).alias("distinct_" + c[len("sketch_"):]) if c.startswith("sketch_")
                             else F.col(c) for c in profiles.columns])


def label_counts(pairs: DataFrame, label: str = "label") -> DataFrame:
    """``Counter(label)``."""
    return pairs.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stance_ratio(pairs: DataFrame) -> DataFrame:
    """Per topic, rows with stance +1 over rows with stance -1 (null with one stance)."""
    return pairs.groupBy("topic").agg(
        F.count(F.when(F.col("stance") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("stance") == -1, 1)).alias("n_neg"),
    ).withColumn("ratio", F.try_divide(F.col("n_pos").cast("double"), F.col("n_neg").cast("double")))


def distinct_lengths(texts: DataFrame, length: Callable[[str], Column]) -> DataFrame:
    """``len`` of each distinct text of a one-column table; a digest stands for the text in the
    shuffle."""
    col = texts.columns[0]
    return texts.select(F.sha2(col, 256).alias("_d"), length(col).alias("len")).distinct().select("len")


def length_stats(texts: DataFrame, length: Callable[[str], Column], kind: str) -> DataFrame:
    """Lengths of the *distinct* texts of one column: n, min, max, sum, mean."""
    d = distinct_lengths(texts, length)
    return d.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"),
                 F.min("len").cast("long").alias("min_len"), F.max("len").cast("long").alias("max_len"),
                 F.sum("len").cast("long").alias("sum_len"), F.avg("len").alias("mean_len"))


def token_length(col: str) -> Column:
    """Default tokenizer length: non-empty cleaned words."""
    return F.size(words(col))


def max_pair_length(pairs: DataFrame) -> DataFrame:
    """A16 (per actual row, ledger L14): the longest argument + topic in words and tokens."""
    return pairs.agg(
        F.max(word_count("argument") + word_count("topic")).cast("long").alias("max_pair_words"),
        F.max(token_length("argument") + token_length("topic")).cast("long").alias("max_pair_tokens"))


def max_pair_length_by_key(pair_keys: DataFrame, arguments: DataFrame) -> DataFrame:
    """A16 with each argument measured once: word / token lengths of argument + topic per
    argument, joined to the pair keys, then the maximum over pairs."""
    lens = arguments.select(
        "arg_id",
        (word_count("argument") + word_count("topic")).alias("_w"),
        (token_length("argument") + token_length("topic")).alias("_t"))
    return pair_keys.join(lens, "arg_id").agg(
        F.max("_w").cast("long").alias("max_pair_words"),
        F.max("_t").cast("long").alias("max_pair_tokens"))


def histogram(values: DataFrame, value: str, kind: str, density: bool = True) -> DataFrame:
    """``NUM_BINS`` equal-width bins over [min, max], the last bin closed; density
    (count / (n * width)) or raw counts. All bins are listed, empty ones with 0. Equal min and
    max fall in the middle bin of [min - 0.5, max + 0.5], as numpy does."""
    v = values.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    st = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    spread = F.col("hi") - F.col("lo")
    idx = F.when(spread == 0, F.lit(NUM_BINS // 2)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) * NUM_BINS / spread), F.lit(NUM_BINS - 1)))
    counts = (with_scalars(v, st)
              .select(idx.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt")))
    bins = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(NUM_BINS - 1))).alias("bin"))
    lo0 = F.when(spread == 0, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(spread == 0, F.lit(1.0 / NUM_BINS)).otherwise(spread / NUM_BINS)
    out = bins.join(counts, "bin", "left").select(
        F.lit(kind).alias("kind"), (F.col("bin") + 1).alias("bin"),
        (lo0 + F.col("bin") * width).alias("bin_lo"),
        (lo0 + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("cnt", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("cnt", F.lit(0)) / (F.col("n") * width) if density
         else F.coalesce("cnt", F.lit(0)).cast("double")).alias("height"))
    return out


def label_mean_spread(pairs: DataFrame, keys=("arg_id", "key_point_id", "topic"),
                      label: str = "label") -> DataFrame:
    """Sample std (ddof 1) of the mean label per key, for each key column."""
    parts = []
    pairs = materialize(pairs.select(*keys, label), "label-means")     # read once per key
    for key in keys:
        m = pairs.groupBy(key).agg(F.avg(label).alias("m"))
        parts.append(m.agg(F.stddev_samp("m").alias(f"std_{key}")))
    out = parts[0]
    for p in parts[1:]:
        out = with_scalars(out, p)
    return out
