"""Greedy longest-match encoding of words against a vocabulary of pieces.

A word is cut from left to right, each time by the longest piece of the vocabulary that fits; a word
with a place that no piece fits becomes the unknown id. Each *distinct* word is resolved once: its
substrings of at most the longest piece's length are joined to the vocabulary, the longest match of
every place is kept, and a fold over the places walks the word. Texts then meet their words' pieces by
a join whose frequent words are broadcast (``skew.spread_join``).

Any (token, token_id) table serves: one that a user brings, or ``pieces_of_words``, the most frequent
words of E3 completed by the letters, so that every cleaned word can be cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .encode import FIRST_WORD_ID, UNK_ID
from .sizing import materialize
from .skew import HEAD, spread_join

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def pieces_of_words(vocab: DataFrame, size: int) -> DataFrame:
    """The first ``size`` words of a vocabulary, then the letters that are not among them."""
    kept = vocab.filter(F.col("token_id") < FIRST_WORD_ID + size).select("token", "token_id")
    letters = vocab.sparkSession.createDataFrame([(c, i) for i, c in enumerate(LETTERS)], "token string, i int")
    # 26 rows on one side
    new = F.broadcast(letters).join(kept.filter(F.length("token") == 1), "token", "left_anti")
    return kept.unionByName(new.select("token", (F.col("i") + FIRST_WORD_ID + size).cast("int").alias("token_id")))


def cut_words(distinct_words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, ids) of each row of ``distinct_words`` (one column ``word``)."""
    longest = pieces.agg(F.coalesce(F.max(F.length("token")), F.lit(0))).first()[0]
    # substrings at every place: at most the longest piece's length of them
    at = distinct_words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    room = F.least(F.lit(longest), F.length("word") - F.col("at") + 1)
    cand = at.select("word", "at", F.explode(F.sequence(F.lit(1), F.greatest(room, F.lit(1)))).alias("n"))
    cand = cand.select("word", "at", "n", F.expr("substring(word, at, n)").alias("token"))
    # the letters are pieces of nearly every word, so they are the frequent keys
    head = pieces.filter(F.length("token") == 1).orderBy("token").limit(HEAD)
    met = spread_join(cand, pieces, head, "token", "token_id")
    best = met.groupBy("word", "at").agg(F.max(F.when(F.col("token_id").isNotNull(), F.struct("n", "token_id"))).alias("m"))
    places = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("p"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("ids"), F.lit(True).alias("known"))

    def walk(acc, place):
        m = place["m"]
        taken = F.struct((acc["next"] + m["n"]).alias("next"), F.concat(acc["ids"], F.array(m["token_id"])).alias("ids"),
                         acc["known"].alias("known"))
        stuck = F.struct(acc["next"].alias("next"), acc["ids"].alias("ids"), F.lit(False).alias("known"))
        return F.when(place["at"] != acc["next"], acc).when(m.isNull(), stuck).otherwise(taken)

    return places.select("word", F.aggregate("p", start, walk).alias("r")).select(
        "word", F.when(F.col("r.known"), F.col("r.ids")).otherwise(F.array(F.lit(UNK_ID))).alias("ids"))


def _pieces_of_texts(texts: DataFrame, key: str, text_col: str, pieces: DataFrame, keep: int | None) -> DataFrame:
    """(key, pos, ids) of the (first ``keep``) words of each text; one row with null ids for no words."""
    w = words(text_col)
    t = texts.select(key, (F.slice(w, 1, keep) if keep else w).alias("_w"))
    ex = t.select(key, F.posexplode_outer("_w").alias("pos", "word"))
    counts = materialize(ex.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    cut = materialize(cut_words(counts.select("word"), pieces), "cut-words")
    frequent = counts.orderBy(F.desc("n"), "word").limit(HEAD).select("word")
    head = cut.join(F.broadcast(frequent), "word", "left_semi")      # HEAD rows
    return spread_join(ex, cut, head, "word", "ids")


def encode_subwords(texts: DataFrame, key: str, text_col: str, pieces: DataFrame, max_length: int) -> DataFrame:
    """(key, ids): the first ``max_length`` piece ids of each text (none for an empty one). A word
    gives at least one piece, so the first ``max_length`` words are enough."""
    x = _pieces_of_texts(texts, key, text_col, pieces, max_length)
    entry = F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))
    each = x.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    return each.select(key, F.slice(F.flatten(F.transform("_s", lambda e: e["ids"])), 1, max_length).alias("ids"))


def subword_lengths(texts: DataFrame, key: str, text_col: str, pieces: DataFrame) -> DataFrame:
    """(key, len): the pieces of each whole text (A15 with a piece tokenizer)."""
    x = _pieces_of_texts(texts, key, text_col, pieces, None)
    return x.groupBy(key).agg(F.sum(F.coalesce(F.size("ids"), F.lit(0))).cast("long").alias("len"))
