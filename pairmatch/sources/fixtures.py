"""Task tables derived from the generated parquet tables (FIXTURES.md section 2).

The reference reads arguments / key points / labels CSVs that are not shipped; these derivations
stand in for them. Every table keeps a ``subset`` column (train / dev / test by topic id) instead
of living in separate files, so one scan serves every subset and a filter prunes the rest.
Helper columns (doc_id, item_id, tid) are kept on the ``*_raw`` frames only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed values of the derivation (FIXTURES.md section 2): hash multipliers and moduli.
ARG_TOPICS = 10            # arguments: topic id = int(source[3:]) % 10
KP_TOPICS = 9              # key points: topic id = item_id % 9 (topic 9 gets none)
GOLD_KEEP = (7919, 104729, 101, 81)        # pair has a gold row if (d*a + i*b) % m < t
GOLD_POSITIVE = (15485863, 32452843, 97, 29)
LOGIT0 = (48611, 7907, 1009, 500)          # l0 = (d*a + i*b) % m - shift
LOGIT1 = (37199, 9973, 1009, 500)
LOGIT_SCALE = 100.0        # logits are integers in hundredths


# Schemas of the generated source tables we read (TESTDATA.md). Declaring them spares a
# footer-reading job per scan; unknown tables fall back to the file schema.
SOURCE_SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if name in SOURCE_SCHEMAS:
        return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def subset_of(tid) -> F.Column:
    return (F.when(tid <= 5, F.lit("train"))
            .when(tid <= 7, F.lit("dev"))
            .otherwise(F.lit("test")))


def arguments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arguments_from_documents(read_table(spark, sf_dir, "documents"))


def arguments_from_documents(docs: DataFrame) -> DataFrame:
    """Argument rows (with helpers) from ``documents`` rows; works on a stream as well."""
    tid = (F.expr("substr(source, 4)").cast("int") % ARG_TOPICS).cast("int")
    return (docs.select("doc_id", "text", "source", "n_chars")
            .withColumn("tid", tid)
            .select(
                "doc_id", "tid",
                F.concat(F.lit("arg_"), F.col("tid").cast("string"), F.lit("_"),
                         F.col("doc_id").cast("string")).alias("arg_id"),
                F.col("text").alias("argument"),
                F.concat(F.lit("topic "), F.col("tid").cast("string")).alias("topic"),
                F.when(F.col("n_chars") % 2 == 0, 1).otherwise(-1).cast("int").alias("stance"),
                subset_of(F.col("tid")).alias("subset")))


def key_points_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = read_table(spark, sf_dir, "benchmark")
    tid = (F.col("item_id") % KP_TOPICS).cast("int")
    return (bench.select("item_id", "text")
            .withColumn("tid", tid)
            .select(
                "item_id", "tid",
                F.concat(F.lit("kp_"), F.col("tid").cast("string"), F.lit("_"),
                         F.col("item_id").cast("string")).alias("key_point_id"),
                F.col("text").alias("key_point"),
                F.concat(F.lit("topic "), F.col("tid").cast("string")).alias("topic"),
                F.when(F.expr(f"(item_id div {KP_TOPICS}) % 2") == 0, 1).otherwise(-1)
                .cast("int").alias("stance"),
                subset_of(F.col("tid")).alias("subset")))


def _hash_mod(a: int, b: int, m: int) -> F.Column:
    return (F.col("doc_id") * a + F.col("item_id") * b) % m


def _same_side_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, item) pairs of one topic id and stance: the raw candidate set behind labels and
    logits. Key points are the small side."""
    a = arguments_raw(spark, sf_dir).select("doc_id", "tid", "stance", "arg_id", "topic", "subset")
    k = key_points_raw(spark, sf_dir).select("item_id", "tid", "stance", "key_point_id")
    return a.join(k, ["tid", "stance"])


def labels_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    a_, b_, m_, t_ = GOLD_KEEP
    pa, pb, pm, pt = GOLD_POSITIVE
    return (_same_side_pairs(spark, sf_dir)
            .filter(_hash_mod(a_, b_, m_) < t_)
            .select("arg_id", "key_point_id",
                    F.when(_hash_mod(pa, pb, pm) < pt, 1).otherwise(0).cast("int").alias("label"),
                    "subset"))


def logits_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer output: two integer logits per candidate pair (class 0, class 1)."""
    return with_logits(_same_side_pairs(spark, sf_dir))


def with_logits(same_side: DataFrame) -> DataFrame:
    """The fixture scorer on (doc_id, item_id) pairs: integer logits l0, l1."""
    a0, b0, m0, s0 = LOGIT0
    a1, b1, m1, s1 = LOGIT1
    return same_side.select("arg_id", "topic", "stance", "key_point_id",
                            (_hash_mod(a0, b0, m0).cast("int") - s0).alias("l0"),
                            (_hash_mod(a1, b1, m1).cast("int") - s1).alias("l1"),
                            "subset")


@dataclass
class TaskTables:
    """The three task tables plus scorer logits, all carrying ``subset``."""
    arguments: DataFrame      # arg_id, argument, topic, stance, subset
    key_points: DataFrame     # key_point_id, key_point, topic, stance, subset
    labels: DataFrame         # arg_id, key_point_id, label, subset
    logits: DataFrame         # arg_id, topic, stance, key_point_id, l0, l1, subset

    def subset(self, name: str) -> "TaskTables":
        f = F.col("subset") == name
        return TaskTables(self.arguments.filter(f), self.key_points.filter(f),
                          self.labels.filter(f), self.logits.filter(f))


def load_tables(spark: SparkSession, sf_dir: str) -> TaskTables:
    return TaskTables(
        arguments=arguments_raw(spark, sf_dir).drop("doc_id", "tid"),
        key_points=key_points_raw(spark, sf_dir).drop("item_id", "tid"),
        labels=labels_raw(spark, sf_dir),
        logits=logits_raw(spark, sf_dir),
    )


# The same derivations as DuckDB / ANSI SQL, used by the oracle queries. Kept textually
# equal to FIXTURES.md section 2.
SQL_TABLES = """
a AS (
  SELECT doc_id, CAST(substr(source, 4) AS INT) % 10 AS tid,
         concat('arg_', CAST(CAST(substr(source, 4) AS INT) % 10 AS VARCHAR), '_', CAST(doc_id AS VARCHAR)) AS arg_id,
         text AS argument,
         concat('topic ', CAST(CAST(substr(source, 4) AS INT) % 10 AS VARCHAR)) AS topic,
         CAST(CASE WHEN n_chars % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS stance
  FROM documents),
k AS (
  SELECT item_id, CAST(item_id % 9 AS INT) AS tid,
         concat('kp_', CAST(item_id % 9 AS VARCHAR), '_', CAST(item_id AS VARCHAR)) AS key_point_id,
         text AS key_point, concat('topic ', CAST(item_id % 9 AS VARCHAR)) AS topic,
         CAST(CASE WHEN floor(item_id / 9) % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS stance
  FROM benchmark),
lab AS (
  SELECT a.arg_id, k.key_point_id,
         CAST(CASE WHEN (a.doc_id * 15485863 + k.item_id * 32452843) % 97 < 29 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM a JOIN k ON a.tid = k.tid AND a.stance = k.stance
  WHERE (a.doc_id * 7919 + k.item_id * 104729) % 101 < 81),
pred AS (
  SELECT a.arg_id, a.topic, a.stance, k.key_point_id,
         CAST((a.doc_id * 48611 + k.item_id * 7907) % 1009 AS INT) - 500 AS l0,
         CAST((a.doc_id * 37199 + k.item_id * 9973) % 1009 AS INT) - 500 AS l1
  FROM a JOIN k ON a.tid = k.tid AND a.stance = k.stance)
"""


def fold_logits(logits: DataFrame, num_folds: int = 7) -> DataFrame:
    """Per-fold scorer outputs for the ensemble queries: fold f keeps l0 and uses
    l1_f = ((l1 + 500) * (f + 1)) % 1009 - 500. Adds ``fold``; rows that have one keep it."""
    _, _, m1, s1 = LOGIT1
    f = F.explode(F.sequence(F.lit(0), F.lit(num_folds - 1))).alias("fold")
    x = logits if "fold" in logits.columns else logits.select("*", f)
    return x.withColumn("l1", ((F.col("l1") + s1) * (F.col("fold") + 1)) % m1 - s1)
