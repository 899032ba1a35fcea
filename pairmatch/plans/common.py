"""Shared pieces of the registered queries: the derived task tables, the scorer output and
output normalisation (doubles rounded to 6 digits, integers as BIGINT) so results compare
exactly across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import sigmoid
from ..sources.fixtures import LOGIT_SCALE, TaskTables, load_tables

ROUND = 6


def tables(spark: SparkSession, sf_dir: str) -> TaskTables:
    return load_tables(spark, sf_dir)


def logit_score(l0: str = "l0", l1: str = "l1", scale: float = LOGIT_SCALE):
    """Positive-class softmax of integer logits in hundredths: 1 / (1 + exp((l0 - l1) / 100)),
    computed from the integer difference so both engines see the same double."""
    return sigmoid((F.col(l1) - F.col(l0)).cast("double") / F.lit(scale))


def scored_candidates(t: TaskTables) -> DataFrame:
    """Scorer output for every candidate pair: arg_id, topic, stance, key_point_id, l0, l1,
    score, prediction (argmax class)."""
    return t.logits.select("arg_id", "topic", "stance", "key_point_id", "l0", "l1",
                           logit_score().alias("score"),
                           (F.col("l1") > F.col("l0")).cast("int").alias("prediction"),
                           "subset")


def normalised(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Round doubles, widen integral counts to BIGINT (labels / stance stay INT)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(c, digits).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(F.round(c.cast("double"), digits).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def sql(body: str) -> str:
    """Oracle SQL over the derived tables a, k, lab, pred (FIXTURES.md section 2)."""
    from ..sources.fixtures import SQL_TABLES
    return "WITH " + SQL_TABLES.strip() + ",\n" + body.strip()


# Reusable oracle fragments.
SQL_SCORED = """
scored AS (
  SELECT arg_id, topic, stance, key_point_id, l0, l1,
         1.0 / (1.0 + exp(CAST(l0 - l1 AS DOUBLE) / 100.0)) AS score,
         CAST(CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS INTEGER) AS prediction
  FROM pred)"""

SQL_MATCHED = SQL_SCORED + """,
best AS (
  SELECT arg_id, key_point_id, score FROM (
    SELECT arg_id, key_point_id, score,
           row_number() OVER (PARTITION BY arg_id ORDER BY score DESC, key_point_id) AS rn
    FROM scored WHERE key_point_id IN (SELECT key_point_id FROM k)) WHERE rn = 1),
comp AS (
  SELECT a.arg_id, a.topic, a.stance, coalesce(b.key_point_id, 'dummy_id') AS key_point_id,
         coalesce(b.score, 0.0) AS score
  FROM a LEFT JOIN best b ON a.arg_id = b.arg_id),
matched AS (
  SELECT c.arg_id, c.topic, c.stance, c.key_point_id, c.score,
         CAST(CASE WHEN c.key_point_id = 'dummy_id' THEN 0 ELSE l.label END AS INTEGER) AS label,
         CAST(coalesce(CASE WHEN c.key_point_id = 'dummy_id' THEN 0 ELSE l.label END, 0) AS INTEGER) AS label_strict,
         CAST(coalesce(CASE WHEN c.key_point_id = 'dummy_id' THEN 0 ELSE l.label END, 1) AS INTEGER) AS label_relaxed
  FROM comp c LEFT JOIN lab l ON c.arg_id = l.arg_id AND c.key_point_id = l.key_point_id)"""

SQL_AP = SQL_MATCHED + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic, stance ORDER BY score DESC, arg_id) AS rn,
         count(*) OVER (PARTITION BY topic, stance) AS n
  FROM matched),
top AS (
  SELECT topic, stance,
         CASE WHEN key_point_id = 'dummy_id' THEN CAST(0.99 AS DOUBLE) ELSE score END AS score,
         label_strict, label_relaxed
  FROM ranked WHERE rn <= floor(n * 0.5)),
per_score AS (
  SELECT topic, stance, score, count(*) AS c,
         CAST(sum(label_strict) AS BIGINT) AS p_s, CAST(sum(label_relaxed) AS BIGINT) AS p_r
  FROM top GROUP BY topic, stance, score),
cum AS (
  SELECT *, sum(c) OVER w AS cc, sum(p_s) OVER w AS cps, sum(p_r) OVER w AS cpr
  FROM per_score
  WINDOW w AS (PARTITION BY topic, stance ORDER BY score DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sums AS (
  SELECT topic, stance, sum(p_s * cps / cc) AS s_s, sum(p_r * cpr / cc) AS s_r
  FROM cum GROUP BY topic, stance),
cnt AS (
  SELECT topic, stance, count(*) AS n_group, CAST(floor(count(*) * 0.5) AS BIGINT) AS n_top
  FROM matched GROUP BY topic, stance),
ap AS (
  SELECT cnt.topic, cnt.stance, n_group, n_top,
         CASE WHEN n_top = 0 THEN NULL ELSE coalesce(s_s, 0) / n_top END AS ap_strict,
         CASE WHEN n_top = 0 THEN NULL ELSE coalesce(s_r, 0) / n_top END AS ap_relaxed
  FROM cnt LEFT JOIN sums ON cnt.topic = sums.topic AND cnt.stance = sums.stance)"""
