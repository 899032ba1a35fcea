"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of ``documents`` (n_chars follows the text). ``run`` writes every
stage's result to the shared folder and reads it again as the next stage's input.

1. quality rules: documents that the base rules or the isolation forest reject go;
2. line dedup: boilerplate lines of a source are dropped from its documents;
3. near-dedup: of each class of near duplicates (BagMinHash) one document stays;
4. substring dedup: spans of 20 words or more that occur earlier are cut out;
5. packing: the rest is packed into sequences of 2,048 ids.

Documents whose text a stage empties stay, with an empty text. The stages set the session's Arrow
batches to a few MB: their rows hold whole texts, and their results are only computed when they are
written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.llm.common import BATCHES, stored, table
from pairmatch.llm.lines import site_line_dedup
from pairmatch.llm.minhash import keep_one
from pairmatch.llm.packing import pack
from pairmatch.llm.quality import keep_good
from pairmatch.llm.substring import remove_repeats

OTHERS = ("doc_id", "lang", "source")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def _small_batches(spark: SparkSession) -> None:
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return keep_good(docs.select("doc_id", "text", "lang", "source", "n_chars"), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(site_line_dedup(docs, carry=OTHERS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return keep_one(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return _documents(remove_repeats(docs, carry=OTHERS, want=("text",)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", packing)]

# The forest, the signatures and the packing have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
