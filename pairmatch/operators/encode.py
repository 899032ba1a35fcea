"""Vocabulary and fixed-length pair encoding (E3-E6), as Spark jobs.

The reference calls a pretrained subword tokenizer row by row. Here the tokenizer is the
cleaned-word split (``functions.text.words``) and the vocabulary is learned from the corpus
(E3); encoding is array expressions plus one join against the vocabulary, whose most frequent
words are met by broadcast (``skew.spread_join``), so that a word in a third of all texts gathers
nowhere.
Every text is tokenised whole (its full length drives the truncation split); only the kept
prefix is mapped to ids, once per distinct text, not once per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .ranking import global_rank
from .skew import HEAD, spread_join

# Special token ids and the number of specials around a pair / a single text.
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
PAIR_SPECIALS = 3      # [CLS] a [SEP] b [SEP]
SINGLE_SPECIALS = 2    # [CLS] t [SEP]


def vocabulary(texts: DataFrame, text_col: str, size: int | None = None) -> DataFrame:
    """The cleaned words of the corpus by falling frequency, ties by word; ids from
    FIRST_WORD_ID in that order. All words, or the first ``size`` of them. Word counts combine
    map-side, so frequent words are not hot keys, and the ids are a distributed rank."""
    counts = (texts.select(F.explode(words(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = global_rank(counts, [F.col("n").desc(), F.col("token").asc()])
    if size is not None:
        ranked = ranked.filter(F.col("rank") <= size)
    return ranked.select("token", (F.col("rank") - 1 + FIRST_WORD_ID).cast("int").alias("token_id"), "n")


def truncate_longest_first(n1: Column, n2: Column, budget: int) -> tuple[Column, Column]:
    """Lengths kept from each side by ``longest_first`` truncation (ledger L7, closed form):
    the shorter side keeps as much as it can, the longer side the rest; when both are long
    the budget is split evenly (odd token to the longer)."""
    m = F.lit(budget)
    a = F.least(n1, n2)
    b = F.greatest(n1, n2)
    b = F.when(a > m, a).otherwise(F.greatest(a, m - a))
    over = (a + b) > m
    a2 = F.when(over, F.floor(m / 2)).otherwise(a).cast("int")
    b2 = F.when(over, F.floor(m / 2) + (m % 2)).otherwise(b).cast("int")
    fits = (n1 + n2) <= m
    first_short = n1 <= n2
    k1 = F.when(fits, n1).when(first_short, a2).otherwise(b2)
    k2 = F.when(fits, n2).when(first_short, b2).otherwise(a2)
    return k1.cast("int"), k2.cast("int")


def token_ids(texts: DataFrame, key: str, text_col: str, vocab: DataFrame,
              keep: int) -> DataFrame:
    """(key, n_tokens, ids) per row of ``texts``: the full token count and the ids of the
    first ``keep`` tokens (unknown words -> UNK_ID). One pass over each text: the kept prefix
    is exploded with positions (``posexplode_outer`` keeps empty texts), joined to the
    vocabulary and regrouped per key (at most ``keep`` rows per group). Ids are ranks by falling
    frequency, so the lowest ``HEAD`` ids are the frequent words."""
    # Tokenise in a projection below the explode: a column computed next to a generator is
    # evaluated once per generated row, which would re-run the regex per kept token.
    t = texts.select(key, words(text_col).alias("_w"))
    t = t.select(key, F.size("_w").alias("n_tokens"), F.slice("_w", 1, keep).alias("_p"))
    ex = t.select(key, "n_tokens", F.posexplode_outer("_p").alias("pos", "token"))
    head = vocab.filter(F.col("token_id") < FIRST_WORD_ID + HEAD)
    mapped = spread_join(ex, vocab, head, "token", "token_id")
    entry = F.when(F.col("pos").isNotNull(),
                   F.struct("pos", F.coalesce("token_id", F.lit(UNK_ID)).alias("token_id")))
    ids = mapped.groupBy(key).agg(F.max("n_tokens").alias("n_tokens"),
                                  F.array_sort(F.collect_list(entry)).alias("_s"))
    return ids.select(key, "n_tokens",
                      F.transform("_s", lambda e: e["token_id"]).cast("array<int>").alias("ids"))


def _pad(arr: Column, length: int, value: int) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value), F.lit(length) - F.size(arr)))


def encode_pairs(pairs: DataFrame, vocab: DataFrame, max_length: int = 40,
                 a_texts: DataFrame | None = None, b_texts: DataFrame | None = None,
                 a_key: str = "arg_id", a_text: str = "argument",
                 b_key: str = "key_point_id", b_text: str = "key_point") -> DataFrame:
    """E4 (+E6): input_ids, attention_mask, token_type_ids of [CLS] a [SEP] b [SEP], truncated
    longest-first and padded to ``max_length``. Keys (and any other pair columns) are carried.

    Texts are tokenised once per distinct key. Pass the text tables (``a_texts``: a_key,
    a_text; ``b_texts``: b_key, b_text) to read each text once from its source; otherwise they
    are taken from the pair rows (deduplicated by key, which shuffles the texts once)."""
    budget = max_length - PAIR_SPECIALS
    if a_texts is None:
        a_texts = pairs.select(a_key, a_text).dropDuplicates([a_key])
    else:
        a_texts = a_texts.select(a_key, a_text).join(pairs.select(a_key).distinct(), a_key, "left_semi")
    if b_texts is None:
        b_texts = pairs.select(b_key, b_text).dropDuplicates([b_key])
    a_ids = token_ids(a_texts, a_key, a_text, vocab, budget).withColumnsRenamed(
        {"n_tokens": "_n1", "ids": "_a"})
    b_ids = token_ids(b_texts.select(b_key, b_text), b_key, b_text, vocab, budget
                      ).withColumnsRenamed({"n_tokens": "_n2", "ids": "_b"})
    keep = [c for c in pairs.columns if c not in (a_text, b_text)]
    x = pairs.select(*keep).join(a_ids, a_key).join(b_ids, b_key)
    k1, k2 = truncate_longest_first(F.col("_n1"), F.col("_n2"), budget)
    x = x.withColumn("_k1", k1).withColumn("_k2", k2)
    a = F.slice("_a", 1, F.col("_k1"))
    b = F.slice("_b", 1, F.col("_k2"))
    seq = F.concat(F.array(F.lit(CLS_ID)), a, F.array(F.lit(SEP_ID)), b, F.array(F.lit(SEP_ID)))
    real = F.col("_k1") + F.col("_k2") + PAIR_SPECIALS
    types = F.concat(F.array_repeat(F.lit(0), F.col("_k1") + 2),
                     F.array_repeat(F.lit(1), F.col("_k2") + 1))
    return (x.withColumn("input_ids", _pad(seq, max_length, PAD_ID))
            .withColumn("attention_mask", _pad(F.array_repeat(F.lit(1), real), max_length, 0))
            .withColumn("token_type_ids", _pad(types, max_length, 0))
            .drop("_n1", "_n2", "_a", "_b", "_k1", "_k2"))


def encode_single(texts: DataFrame, key: str, text_col: str, vocab: DataFrame,
                  max_length: int) -> DataFrame:
    """[CLS] t [SEP] truncated to ``max_length`` and padded: key, ids, mask, types."""
    budget = max_length - SINGLE_SPECIALS
    t = token_ids(texts, key, text_col, vocab, budget)
    seq = F.concat(F.array(F.lit(CLS_ID)), F.col("ids"), F.array(F.lit(SEP_ID)))
    return t.select(key, _pad(seq, max_length, PAD_ID).alias("seg_ids"),
                    _pad(F.array_repeat(F.lit(1), F.size("ids") + SINGLE_SPECIALS), max_length, 0)
                    .alias("seg_mask"),
                    F.array_repeat(F.lit(0), F.lit(max_length)).alias("seg_types"))


def append_segment(encoded: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """E5: concat a separately encoded segment (first token dropped) onto ids / mask / types."""
    x = encoded.join(segments, key)
    tail = lambda c: F.slice(F.col(c), 2, F.size(F.col(c)))
    return (x.withColumn("input_ids", F.concat("input_ids", tail("seg_ids")))
            .withColumn("attention_mask", F.concat("attention_mask", tail("seg_mask")))
            .withColumn("token_type_ids", F.concat("token_type_ids", tail("seg_types")))
            .drop("seg_ids", "seg_mask", "seg_types"))
