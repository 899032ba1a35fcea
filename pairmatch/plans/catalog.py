"""Registered queries: one Spark plan per operator of the survey inventory, each over the whole
derived tables of a scale-factor folder, with its DuckDB oracle SQL where one exists.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import matching, metrics, pairs
from ..operators.sizing import materialize, with_scalars
from . import common as C
from . import evaluate as EV

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = C.sql(oracle)
        return fn
    return deco


def _matched(t) -> DataFrame:
    scored = C.scored_candidates(t).select("arg_id", "key_point_id", "score")
    return matching.get_predictions(scored, t.arguments, t.key_points, t.labels)


# ---------------------------------------------------------------- flagship: submission scoring

@register("mean_average_precision", C.SQL_AP + """
SELECT round(avg(ap_strict), 6) AS mAP_strict, round(avg(ap_relaxed), 6) AS mAP_relaxed FROM ap""")
def q_mean_average_precision(spark, sf):
    """mAP strict / relaxed of the best match per argument (Entry 3, ``calc_map``)."""
    return C.normalised(metrics.mean_average_precision(_matched(C.tables(spark, sf))))


@register("average_precision", C.SQL_AP + """
SELECT topic, stance, n_group, n_top, round(ap_strict, 6) AS ap_strict,
       round(ap_relaxed, 6) AS ap_relaxed FROM ap""")
def q_average_precision(spark, sf):
    """Retrieval AP per (topic, stance)."""
    return C.normalised(metrics.group_average_precision(_matched(C.tables(spark, sf))))


@register("best_match", C.SQL_MATCHED + """
SELECT arg_id, key_point_id, round(score, 6) AS score FROM best""")
def q_best_match(spark, sf):
    """Best known key point per argument."""
    t = C.tables(spark, sf)
    scored = C.scored_candidates(t).select("arg_id", "key_point_id", "score")
    return C.normalised(matching.best_match(scored, t.key_points))


@register("match_gold", C.SQL_MATCHED + """
SELECT arg_id, topic, stance, key_point_id, round(score, 6) AS score, label, label_strict,
       label_relaxed FROM matched""")
def q_match_gold(spark, sf):
    """J5 + J6 + P5 + P6: one row per argument with strict / relaxed gold labels."""
    return C.normalised(_matched(C.tables(spark, sf)))


@register("match_coverage", C.SQL_MATCHED + """
SELECT stance, topic, count(*) AS n_arguments,
       count(CASE WHEN key_point_id <> 'dummy_id' THEN 1 END) AS n_matched,
       round(count(CASE WHEN key_point_id <> 'dummy_id' THEN 1 END) / count(*), 6) AS coverage
FROM matched GROUP BY stance, topic""")
def q_match_coverage(spark, sf):
    """Share of arguments with a real key point per (stance, topic)."""
    return C.normalised(matching.match_coverage(_matched(C.tables(spark, sf))))


@register("top_fraction", C.SQL_MATCHED + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic, stance ORDER BY score DESC, arg_id) AS rn,
         count(*) OVER (PARTITION BY topic, stance) AS n
  FROM matched)
SELECT topic, stance, arg_id, key_point_id, round(score, 6) AS score, rn AS rank,
       n AS n_group, CAST(floor(n * 0.5) AS BIGINT) AS n_top
FROM ranked WHERE rn <= floor(n * 0.5)""")
def q_top_fraction(spark, sf):
    """Top half by score per (topic, stance), ties by arg_id."""
    top = metrics.top_fraction(_matched(C.tables(spark, sf)), ["topic", "stance"], 0.5)
    return C.normalised(top.select("topic", "stance", "arg_id", "key_point_id", "score",
                                   "rank", "n_group", "n_top"))


# ---------------------------------------------------------------- pairs

@register("labelled_pairs", """
SELECT l.arg_id, a.argument, l.key_point_id, k.key_point, a.topic, a.stance, l.label
FROM lab l JOIN a ON l.arg_id = a.arg_id JOIN k ON l.key_point_id = k.key_point_id""")
def q_labelled_pairs(spark, sf):
    """J1 + J2: labels joined to argument and key point texts (``generate_combined_df``)."""
    t = C.tables(spark, sf)
    return pairs.labelled_pairs(t.arguments, t.key_points, t.labels).drop("subset")


@register("candidate_pairs", """
SELECT a.arg_id, a.argument, k.key_point_id, k.key_point, a.topic, a.stance,
       CAST(NULL AS INTEGER) AS label
FROM a LEFT JOIN k ON a.topic = k.topic AND a.stance = k.stance AND a.tid = k.tid""")
def q_candidate_pairs(spark, sf):
    """Every same-topic, same-stance pair; arguments without key points kept."""
    t = C.tables(spark, sf)
    return pairs.candidate_pairs(t.arguments, t.key_points)


@register("candidate_pairs_gold", """
SELECT a.arg_id, a.argument, k.key_point_id, k.key_point, a.topic, a.stance, l.label
FROM a LEFT JOIN k ON a.topic = k.topic AND a.stance = k.stance AND a.tid = k.tid
LEFT JOIN lab l ON l.arg_id = a.arg_id AND l.key_point_id = k.key_point_id""")
def q_candidate_pairs_gold(spark, sf):
    """J3 + J4: candidates with the gold label where one exists."""
    t = C.tables(spark, sf)
    return pairs.candidate_pairs(t.arguments, t.key_points, t.labels)


# ---------------------------------------------------------------- classification metrics

_SQL_LABELLED = C.SQL_SCORED + """,
labelled AS (
  SELECT s.*, l.label FROM scored s JOIN lab l
  ON s.arg_id = l.arg_id AND s.key_point_id = l.key_point_id)"""

_SQL_AUC_BODY = """
auc_ps AS (
  SELECT {g} score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
         count(CASE WHEN label = 0 THEN 1 END) AS neg
  FROM {src} GROUP BY {g} score),
auc_cum AS (
  SELECT *, sum(neg) OVER (PARTITION BY {p} ORDER BY score
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg
  FROM auc_ps),
auc AS (
  SELECT {g} CAST(sum(pos * (cneg - neg + neg * 0.5)) AS DOUBLE)
         / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc
  FROM auc_cum GROUP BY {gg})"""


def _sql_metrics(src: str, group: str | None, final: str = "SELECT * FROM metrics",
                 rounded: bool = True) -> str:
    """Oracle CTEs for evaluate(): ends with a ``metrics`` CTE, then ``final``."""
    r = (lambda x: f"round({x}, 6)") if rounded else (lambda x: x)
    g = f"{group}, " if group else ""
    gg = group if group else "ALL"
    p = group if group else "1"
    auc = _SQL_AUC_BODY.format(g=g, src=src, p=p, gg=gg)
    join = f"JOIN auc USING ({group})" if group else ", auc"
    sel = f"c.{group}, " if group else ""
    return f""",
conf AS (
  SELECT {g} count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp,
         count(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp,
         count(CASE WHEN label = 1 AND prediction <> 1 THEN 1 END) AS fn,
         count(CASE WHEN label = 0 AND prediction <> 1 THEN 1 END) AS tn
  FROM {src} GROUP BY {gg}),{auc},
metrics AS (
SELECT {sel}
  {r("CAST(tn AS DOUBLE) / nullif(tn + fp, 0)")} AS acc_neg,
  {r("CAST(tp AS DOUBLE) / nullif(tp + fn, 0)")} AS acc_pos,
  {r("CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0)")} AS acc,
  {r("coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)")} AS prec,
  {r("coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)")} AS recall,
  {r("coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fn, 0), 0)")} AS f1_pos,
  {r("coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0)")} AS f1,
  {r("auc")} AS auc
FROM conf c {join})
{final}"""


def _labelled(t) -> DataFrame:
    s = C.scored_candidates(t)
    return s.join(t.labels.select("arg_id", "key_point_id", "label"), ["arg_id", "key_point_id"])


@register("binary_metrics", _SQL_LABELLED + _sql_metrics("labelled", None))
def q_binary_metrics(spark, sf):
    """A1-A4: evaluate() over all labelled candidates (class = l1 > l0)."""
    return C.normalised(metrics.binary_metrics(_labelled(C.tables(spark, sf))))


@register("metrics_by_subset", _SQL_LABELLED.replace(
    "SELECT s.*, l.label", "SELECT s.*, CASE WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 5 "
    "THEN 'train' WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 7 THEN 'dev' ELSE 'test' END "
    "AS subset, l.label") + _sql_metrics("labelled", "subset"))
def q_metrics_by_subset(spark, sf):
    """A5: the metric set per subset in one pass (instead of one pass per suffix)."""
    return C.normalised(metrics.binary_metrics(_labelled(C.tables(spark, sf)),
                                               group_cols=["subset"]))


@register("roc_auc", _SQL_LABELLED + "," + _SQL_AUC_BODY.format(g="", src="labelled", p="1", gg="ALL")
          + "\nSELECT round(auc, 6) AS auc FROM auc")
def q_roc_auc(spark, sf):
    """A4: ROC AUC over labelled candidates."""
    return C.normalised(metrics.roc_auc(_labelled(C.tables(spark, sf)).withColumn("_all", F.lit(0)),
                                        group_cols=["_all"]).select("auc"))


@register("classified_metrics", _SQL_LABELLED.replace(
    "SELECT s.*, l.label", "SELECT s.*, CASE WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 5 "
    "THEN 'train' WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 7 THEN 'dev' ELSE 'test' END "
    "AS subset, l.label") + _sql_metrics(
    "labelled", "subset", "SELECT subset, acc_neg AS neg_acc, acc_pos AS pos_acc, acc AS all_acc, "
    "f1 AS all_f1, auc AS all_auc FROM metrics"))
def q_classified_metrics(spark, sf):
    """neg_acc, pos_acc, all_acc, all_f1, all_auc per subset."""
    return C.normalised(metrics.classified_metrics(_labelled(C.tables(spark, sf)),
                                                   group_cols=["subset"]))


@register("precision_recall_curve", _SQL_LABELLED.replace(
    "SELECT s.*, l.label", "SELECT s.*, CASE WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 5 "
    "THEN 'train' WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 7 THEN 'dev' ELSE 'test' END "
    "AS subset, l.label") + """,
per_score AS (
  SELECT subset, score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
         count(CASE WHEN label <> 1 THEN 1 END) AS neg
  FROM labelled GROUP BY subset, score),
cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY subset) AS p_all
  FROM per_score
  WINDOW w AS (PARTITION BY subset ORDER BY score DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT subset, round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
       round(CAST(tp AS DOUBLE) / nullif(p_all, 0), 6) AS recall
FROM cum""")
def q_precision_recall_curve(spark, sf):
    """Precision / recall at every distinct score threshold, per subset."""
    return C.normalised(metrics.precision_recall_curve(_labelled(C.tables(spark, sf)),
                                                       group_cols=["subset"]))


# ---------------------------------------------------------------- text functions

from ..functions import text as TX  # noqa: E402
from ..functions import scores as SC  # noqa: E402
from ..sources.fixtures import read_table  # noqa: E402

_CLEAN_SQL = "regexp_replace(lower({c}), '[^a-zA-Z]', ' ', 'g')"


@register("clean_text", f"""
SELECT arg_id, {_CLEAN_SQL.format(c="argument")} AS argument_clean FROM a""")
def q_clean_text(spark, sf):
    """C1 + C2 (``string_preprocessing``) over every argument text."""
    t = C.tables(spark, sf)
    return t.arguments.select("arg_id", TX.clean_text("argument").alias("argument_clean"))


@register("strip_urls", r"""
SELECT page_id, regexp_replace(url, 'https?://\S+|www\.\S+', '', 'g') AS url_stripped,
       regexp_replace(html, 'https?://\S+|www\.\S+', '', 'g') AS html_stripped
FROM pages""")
def q_strip_urls(spark, sf):
    """C3 over page urls and html."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", TX.strip_urls("url").alias("url_stripped"),
                    TX.strip_urls("html").alias("html_stripped"))


@register("strip_tags", """
SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS html_stripped FROM pages""")
def q_strip_tags(spark, sf):
    """C4 over page html."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", TX.strip_tags("html").alias("html_stripped"))


# emoji put into the texts by doc_id: the generated documents hold none
_EMOJI = {0: " \U0001F600\U0001F680 x", 1: "\u2702\U0001F1FA\U0001F1F8"}
_SQL_EMOJI = "text || CASE " + " ".join(f"WHEN doc_id % 3 = {k} THEN '{v}'" for k, v in _EMOJI.items()) + " ELSE '' END"


@register("strip_emoji", r"""
SELECT doc_id, regexp_replace(""" + _SQL_EMOJI + r""", '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+', '', 'g') AS text_stripped
FROM documents""")
def q_strip_emoji(spark, sf):
    """C5 over document texts with emoji added to two thirds of them."""
    d = read_table(spark, sf, "documents").select("doc_id", F.expr(_SQL_EMOJI).alias("text"))
    return d.select("doc_id", TX.strip_emoji("text").alias("text_stripped"))


@register("extract_topic", """
SELECT arg_id AS id, CAST(split_part(arg_id, '_', 2) AS INT) AS topic_id FROM a
UNION ALL
SELECT key_point_id AS id, CAST(split_part(key_point_id, '_', 2) AS INT) AS topic_id FROM k""")
def q_extract_topic(spark, sf):
    """Topic id parsed from argument and key point ids (strict)."""
    t = C.tables(spark, sf)
    ids = t.arguments.select(F.col("arg_id").alias("id")).unionByName(
        t.key_points.select(F.col("key_point_id").alias("id")))
    return ids.select("id", TX.topic_id("id").alias("topic_id"))


@register("stance_text", """
SELECT arg_id, stance, CASE WHEN stance = 1 THEN ' is positive' WHEN stance = -1 THEN ' is negative' END
       AS stance_phrase FROM a""")
def q_stance_text(spark, sf):
    """Stance decoded to its phrase."""
    t = C.tables(spark, sf)
    return t.arguments.select("arg_id", "stance", TX.stance_text("stance").alias("stance_phrase"))


_SQL_PAIRS = """
pairs AS (
  SELECT l.arg_id, a.argument, l.key_point_id, k.key_point, a.topic, a.stance, l.label
  FROM lab l JOIN a ON l.arg_id = a.arg_id JOIN k ON l.key_point_id = k.key_point_id)"""


@register("pair_text", _SQL_PAIRS + f"""
SELECT arg_id, key_point_id, {_CLEAN_SQL.format(c="argument")} AS argument_clean,
       {_CLEAN_SQL.format(c="key_point")} AS key_point_clean FROM pairs""")
def q_pair_text(spark, sf):
    """Cleaned argument and key point of every labelled pair (each text cleaned once)."""
    t = C.tables(spark, sf)
    keys = t.labels.select("arg_id", "key_point_id")
    p = pairs.pair_text_by_key(keys, t.arguments, t.key_points)
    return p.select("arg_id", "key_point_id", "argument_clean", "key_point_clean")


@register("pair_text_topic_stance", _SQL_PAIRS + f"""
SELECT arg_id, key_point_id, {_CLEAN_SQL.format(c="argument")} AS argument_clean,
       {_CLEAN_SQL.format(c="key_point")} AS key_point_clean,
       concat({_CLEAN_SQL.format(c="topic")},
              CASE WHEN stance = 1 THEN ' is positive' ELSE ' is negative' END) AS topic_segment
FROM pairs""")
def q_pair_text_topic_stance(spark, sf):
    """Cleaned pair plus the topic + stance segment (add_info='topic,stance'); texts and the
    segment are made once per argument / key point. There are only a few dozen (topic, stance), so
    the segment comes with the argument: a join on them would gather all pairs in a few tasks."""
    t = C.tables(spark, sf)
    return pairs.pair_text_topic_stance(t.labels.select("arg_id", "key_point_id"), t.arguments, t.key_points).select(
        "arg_id", "key_point_id", "argument_clean", "key_point_clean", "topic_segment")


# ---------------------------------------------------------------- scores

@register("score_softmax", C.SQL_SCORED + """
SELECT arg_id, key_point_id, round(score, 6) AS score FROM scored""")
def q_score_softmax(spark, sf):
    """Positive-class row softmax of the scorer logits."""
    t = C.tables(spark, sf)
    return C.normalised(C.scored_candidates(t).select("arg_id", "key_point_id", "score"))


@register("predict_argmax", C.SQL_SCORED + """
SELECT arg_id, key_point_id, prediction FROM scored""")
def q_predict_argmax(spark, sf):
    """C11: argmax class (ties -> 0)."""
    t = C.tables(spark, sf)
    return t.logits.select("arg_id", "key_point_id",
                           SC.argmax_class("l0", "l1").alias("prediction"))


@register("predict_threshold", """
SELECT arg_id, key_point_id,
       CAST(CASE WHEN 1.0 / (1.0 + exp(-(CAST(l1 - l0 AS DOUBLE) / 100.0))) >= 0.5 THEN 1 ELSE 0 END
            AS INTEGER) AS prediction
FROM pred""")
def q_predict_threshold(spark, sf):
    """Sigmoid of a single logit (l1 - l0) / 100, threshold 0.5 inclusive."""
    t = C.tables(spark, sf)
    x = (F.col("l1") - F.col("l0")).cast("double") / F.lit(100.0)
    return t.logits.select("arg_id", "key_point_id", SC.threshold_class(x, 0.5).alias("prediction"))


_SQL_BATCHED = """
batched AS (
  SELECT arg_id, key_point_id, l0 / 100.0 AS x0, l1 / 100.0 AS x1,
         CAST((row_number() OVER (ORDER BY arg_id, key_point_id) - 1) // 64 AS BIGINT) AS batch_id
  FROM pred)"""


@register("score_batch_softmax", _SQL_BATCHED + """,
bm AS (
  SELECT *, max(greatest(x0, x1)) OVER (PARTITION BY batch_id) AS m FROM batched),
bz AS (
  SELECT *, sum(exp(x0 - m) + exp(x1 - m)) OVER (PARTITION BY batch_id) AS z FROM bm)
SELECT arg_id, key_point_id, batch_id,
       round(1.0 / (1.0 + exp(exp(x0 - m) / z - exp(x1 - m) / z)), 6) AS score
FROM bz""")
def q_score_batch_softmax(spark, sf):
    """C10 (ledger L5): softmax over the whole batch of 64, then a row softmax. Batches are
    numbered by the distributed two-level rank over (arg_id, key_point_id)."""
    from ..operators.scoring import number_batches
    t = C.tables(spark, sf)
    x = t.logits.select("arg_id", "key_point_id",
                        (F.col("l0") / F.lit(100.0)).alias("x0"),
                        (F.col("l1") / F.lit(100.0)).alias("x1"))
    b = number_batches(x, ["arg_id", "key_point_id"], 64)
    out = SC.batch_then_row_softmax(b, "x0", "x1", "batch_id")
    return C.normalised(out.select("arg_id", "key_point_id", "batch_id", "score"))


# ---------------------------------------------------------------- losses

_SQL_LAB_LOGITS = """
ll AS (
  SELECT p.arg_id, p.key_point_id, p.l0 / 100.0 AS x0, p.l1 / 100.0 AS x1, l.label
  FROM pred p JOIN lab l ON p.arg_id = l.arg_id AND p.key_point_id = l.key_point_id),
nll AS (
  SELECT *, greatest(x0, x1) + ln(exp(x0 - greatest(x0, x1)) + exp(x1 - greatest(x0, x1)))
            - CASE WHEN label = 1 THEN x1 ELSE x0 END AS nll,
         CASE WHEN label = 1 THEN 4.0 ELSE 1.0 END AS w
  FROM ll)"""


@register("weighted_log_loss", _SQL_LAB_LOGITS + """
SELECT round(avg(nll), 6) AS loss_ce, round(sum(w * nll) / sum(w), 6) AS loss_weighted FROM nll""")
def q_weighted_log_loss(spark, sf):
    """Cross-entropy over labelled candidates, plain and with class weights [1, 4]."""
    t = C.tables(spark, sf)
    ll = _lab_logits(t)
    return C.normalised(ll.agg(
        metrics.weighted_loss("x0", "x1", "label").alias("loss_ce"),
        metrics.weighted_loss("x0", "x1", "label", (1.0, 4.0)).alias("loss_weighted")))


def _lab_logits(t) -> DataFrame:
    return (t.logits.join(t.labels.select("arg_id", "key_point_id", "label"),
                          ["arg_id", "key_point_id"])
            .select("arg_id", "key_point_id", (F.col("l0") / F.lit(100.0)).alias("x0"),
                    (F.col("l1") / F.lit(100.0)).alias("x1"), "label"))


@register("bce_log_loss", """
x AS (
  SELECT (p.l1 - p.l0) / 100.0 AS x, CAST(l.label AS DOUBLE) AS y
  FROM pred p JOIN lab l ON p.arg_id = l.arg_id AND p.key_point_id = l.key_point_id),
sp AS (
  SELECT y, ln(1 + exp(-abs(x))) + greatest(x, 0) AS sp_pos,
         ln(1 + exp(-abs(-x))) + greatest(-x, 0) AS sp_neg FROM x)
SELECT round(avg(y * sp_neg + (1 - y) * sp_pos), 6) AS loss_bce,
       round(avg(4.0 * y * sp_neg + (1 - y) * sp_pos), 6) AS loss_bce_pw4 FROM sp""")
def q_bce_log_loss(spark, sf):
    """BCE with logits on the single logit (l1 - l0) / 100, positive weight 1 and 4."""
    t = C.tables(spark, sf)
    d = (t.logits.join(t.labels.select("arg_id", "key_point_id", "label"),
                       ["arg_id", "key_point_id"])
         .select(((F.col("l1") - F.col("l0")) / F.lit(100.0)).alias("x"), "label"))
    return C.normalised(d.agg(metrics.bce_loss("x", "label").alias("loss_bce"),
                              metrics.bce_loss("x", "label", 4.0).alias("loss_bce_pw4")))


@register("batch_mean_loss", _SQL_LAB_LOGITS + """,
nb AS (
  SELECT nll, CAST((row_number() OVER (ORDER BY arg_id, key_point_id) - 1) // 64 AS BIGINT) AS b
  FROM nll),
per AS (SELECT b, avg(nll) AS m FROM nb GROUP BY b)
SELECT round(avg(m), 6) AS loss, count(*) AS n_batches FROM per""")
def q_batch_mean_loss(spark, sf):
    """Epoch loss as the mean of per-batch mean cross-entropy (batches of 64)."""
    from ..operators.scoring import number_batches
    t = C.tables(spark, sf)
    ll = _lab_logits(t).withColumn("nll", SC.two_class_nll("x0", "x1", "label"))
    b = number_batches(ll, ["arg_id", "key_point_id"], 64)
    return C.normalised(metrics.batch_mean_loss(b, "nll", "batch_id"))


# ---------------------------------------------------------------- filters, samples, unions

@register("invalid_key_points", """
SELECT DISTINCT key_point_id FROM pred
WHERE key_point_id NOT IN (SELECT key_point_id FROM k WHERE tid >= 8)""")
def q_invalid_key_points(spark, sf):
    """A submission over every candidate checked against the test key-point file; each
    unknown key point is listed once."""
    t = C.tables(spark, sf)
    sub = C.scored_candidates(t).select("arg_id", "key_point_id", "score")
    _, invalid = pairs.split_known(sub, t.key_points.filter(F.col("subset") == "test"))
    return invalid


@register("sample_arguments", _SQL_PAIRS + """,
ids AS (SELECT DISTINCT arg_id FROM pairs),
ranked AS (
  SELECT arg_id, row_number() OVER (ORDER BY md5(concat('42|', arg_id)), arg_id) AS rn,
         count(*) OVER () AS n FROM ids)
SELECT p.arg_id, p.key_point_id, p.label FROM pairs p
JOIN ranked r ON p.arg_id = r.arg_id WHERE r.rn <= floor(r.n * 0.5)""")
def q_sample_arguments(spark, sf):
    """T4: all pairs of a reproducible half of the arguments (ratio 0.5, seed 42)."""
    t = C.tables(spark, sf)
    p = pairs.labelled_pairs(t.arguments, t.key_points, t.labels)
    return pairs.sample_arguments(p, 0.5, 42).select("arg_id", "key_point_id", "label")


_SQL_FIT = _SQL_PAIRS.replace("SELECT l.arg_id,", "SELECT a.tid, l.arg_id,")


def _overlapping(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and dev rows of a split in which one topic got into both."""
    both = TX.topic_id("arg_id") == 5
    return rows.filter(F.col("subset") == "train"), rows.filter((F.col("subset") == "dev") | both)


@register("fit_pairs", _SQL_FIT + """
SELECT DISTINCT arg_id, argument, key_point_id, key_point, topic, stance, label
FROM pairs WHERE tid <= 7""")
def q_fit_pairs(spark, sf):
    """Train union dev with full-row dedupe (the k-fold input); topic 5 is in both."""
    t = C.tables(spark, sf)
    keys = [k.select("arg_id", "key_point_id", "label") for k in _overlapping(t.labels)]
    # texts, topic and stance are functions of the ids: duplicates are found on the keys
    return pairs.labelled_pairs(t.arguments, t.key_points, pairs.fit_pairs(*keys))


@register("fit_pairs_all", _SQL_FIT + """
SELECT arg_id, argument, key_point_id, key_point, topic, stance, label
FROM pairs WHERE tid <= 5
UNION ALL SELECT arg_id, argument, key_point_id, key_point, topic, stance, label FROM pairs WHERE tid BETWEEN 5 AND 7""")
def q_fit_pairs_all(spark, sf):
    """Train union dev without dedupe: the pairs of topic 5 come twice."""
    t = C.tables(spark, sf)
    tr, dv = _overlapping(pairs.labelled_pairs(t.arguments, t.key_points, t.labels))
    return pairs.fit_pairs(tr.drop("subset"), dv.drop("subset"), dedupe=False)


# ---------------------------------------------------------------- folds

from ..operators import ensemble as EN  # noqa: E402
from ..operators import folds as FO  # noqa: E402
from ..operators import profile as PR  # noqa: E402
from ..sources.fixtures import fold_logits  # noqa: E402


def _fit_keys(t) -> DataFrame:
    """The k-fold input (U1: train union dev, deduplicated) on keys only. Texts, topic and
    stance are functions of the ids, so deduplicating (arg_id, key_point_id, label, topic)
    keeps exactly the rows of the full-row dedupe -- without shuffling any text."""
    keys = (t.labels.filter(F.col("subset").isin("train", "dev"))
            .select("arg_id", "key_point_id", "label")
            .join(t.arguments.select("arg_id", "topic"), "arg_id")
            .join(t.key_points.select("key_point_id"), "key_point_id"))
    return keys.dropDuplicates()


def sql_kfold(key: str, k: int, src: str = "fit") -> str:
    return f"""
keys AS (SELECT DISTINCT {key} AS key FROM {src}),
key_rank AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM keys),
qr AS (SELECT key, i, n // {k} AS q, n % {k} AS r FROM key_rank),
folds AS (
  SELECT key AS {key}, CAST(i AS BIGINT) AS key_id,
         CAST(CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS INTEGER) AS fold
  FROM qr)"""


_SQL_FIT_DEDUP = _SQL_FIT + """,
fit AS (SELECT DISTINCT arg_id, argument, key_point_id, key_point, topic, stance, label
        FROM pairs WHERE tid <= 7)"""


@register("topic_folds", _SQL_FIT_DEDUP + "," + sql_kfold("topic", 7) + """
SELECT topic, key_id AS topic_id, fold FROM folds""")
def q_topic_folds(spark, sf):
    """F1 + W4: topics of train + dev enumerated in sorted order, 7 contiguous folds."""
    return FO.topic_folds(_fit_keys(C.tables(spark, sf)), 7)


@register("argument_folds", _SQL_FIT_DEDUP + "," + sql_kfold("arg_id", 5) + """
SELECT arg_id, key_id AS arg_key_id, fold FROM folds""")
def q_argument_folds(spark, sf):
    """arguments of train + dev in 5 contiguous folds (distributed rank)."""
    return FO.argument_folds(_fit_keys(C.tables(spark, sf)), 5)


@register("fold_members", _SQL_FIT_DEDUP + "," + sql_kfold("topic", 7) + """
SELECT f.arg_id, f.key_point_id, f.topic, d.fold FROM fit f JOIN folds d ON f.topic = d.topic""")
def q_fold_members(spark, sf):
    """F2 + F3: the row keys of every pair with the fold in which it is the dev set (it is in
    the train set of every other fold)."""
    fit = _fit_keys(C.tables(spark, sf))
    folds = FO.topic_folds(fit, 7)
    return FO.with_folds(fit, folds.select("topic", "fold"), "topic").select(
        "arg_id", "key_point_id", "topic", "fold")


# the train side of a fold holds the rows of every other fold
_SQL_FOLD_SIZES = """
SELECT fold, 'dev' AS role, count(*) AS n_pairs, count(DISTINCT arg_id) AS n_arguments,
       count(DISTINCT topic) AS n_topics FROM m GROUP BY fold
UNION ALL
SELECT i.fold, 'train' AS role, count(*), count(DISTINCT arg_id), count(DISTINCT topic)
FROM (SELECT DISTINCT fold FROM m) i JOIN m ON m.fold <> i.fold GROUP BY i.fold"""


@register("fold_sizes", _SQL_FIT_DEDUP + "," + sql_kfold("topic", 7) + """,
m AS (SELECT f.*, d.fold FROM fit f JOIN folds d ON f.topic = d.topic)
""" + _SQL_FOLD_SIZES)
def q_fold_sizes(spark, sf):
    """train / dev sizes of every topic fold."""
    fit = _fit_keys(C.tables(spark, sf))
    folds = FO.topic_folds(fit, 7)
    return FO.fold_sizes(FO.with_folds(fit, folds.select("topic", "fold"), "topic"))


@register("argument_fold_sizes", _SQL_FIT_DEDUP + "," + sql_kfold("arg_id", 5) + """,
m AS (SELECT f.*, d.fold FROM fit f JOIN folds d ON f.arg_id = d.arg_id)
""" + _SQL_FOLD_SIZES)
def q_argument_fold_sizes(spark, sf):
    """F2 over F4: train / dev sizes of every argument fold (a topic lives in several folds)."""
    fit = _fit_keys(C.tables(spark, sf))
    folds = FO.argument_folds(fit, 5)
    return FO.fold_sizes(FO.with_folds(fit, folds.select("arg_id", "fold"), "arg_id"))


# ---------------------------------------------------------------- ensemble

_SQL_ENS = """
fl AS (
  SELECT p.arg_id, p.key_point_id, p.l0, CAST(f.fold AS INTEGER) AS fold,
         ((p.l1 + 500) * (f.fold + 1)) % 1009 - 500 AS l1f
  FROM pred p CROSS JOIN (SELECT range AS fold FROM range(7)) f),
fs AS (
  SELECT arg_id, key_point_id, fold, 1.0 / (1.0 + exp(CAST(l0 - l1f AS DOUBLE) / 100.0)) AS score,
         CAST(CASE WHEN l1f > l0 THEN 1 ELSE 0 END AS INTEGER) AS prediction
  FROM fl),
ens AS (
  SELECT arg_id, key_point_id, avg(score) AS score, count(*) AS n_folds,
         arg_min(prediction, fold) AS prediction
  FROM fs GROUP BY arg_id, key_point_id)"""


def _fold_scored(t, on: DataFrame | None = None, subset: str | None = None, k: int = 7) -> DataFrame:
    """Fold scorer outputs of all candidates, of one subset, or of the pairs ``on`` (whose own
    ``fold``, where they have one, is the only fold)."""
    x = t.logits if subset is None else t.logits.filter(F.col("subset") == subset)
    if on is not None:
        x = x.join(on, ["arg_id", "key_point_id"])
    x = fold_logits(x, k)
    extra = ["label"] if on is not None else []
    return x.select("arg_id", "key_point_id", "fold", "subset", *extra, C.logit_score().alias("score"),
                    (F.col("l1") > F.col("l0")).cast("int").alias("prediction"))


@register("ensemble_scores", _SQL_ENS + """
SELECT arg_id, key_point_id, round(score, 6) AS score, n_folds, prediction FROM ens""")
def q_ensemble_scores(spark, sf):
    """J9 + A20: mean score over 7 fold scorers per pair; prediction from fold 0."""
    return C.normalised(EN.ensemble_scores(_fold_scored(C.tables(spark, sf))))


@register("ensemble_label_scores", _SQL_ENS + """
SELECT l.arg_id, l.key_point_id, l.label, round(e.score, 6) AS score
FROM lab l LEFT JOIN ens e ON l.arg_id = e.arg_id AND l.key_point_id = e.key_point_id""")
def q_ensemble_label_scores(spark, sf):
    """The label file with the ensemble score attached by key."""
    t = C.tables(spark, sf)
    ens = EN.ensemble_scores(_fold_scored(t))
    return C.normalised(EN.attach_scores(t.labels.select("arg_id", "key_point_id", "label"), ens))




def _nested(src: str, group: str | None) -> str:
    """The metrics of one source as a subquery of its own."""
    return "(WITH z AS (SELECT 1)" + _sql_metrics(src, group, rounded=False) + ")"


_IS_TEST = "CAST(split_part({c}, ' ', 2) AS INT) >= 8"
_SQL_TEST_MAP = f"""
mp AS (SELECT avg(ap_strict) AS s, avg(ap_relaxed) AS r FROM ap WHERE {_IS_TEST.format(c='topic')})"""


@register("kfold_report", _SQL_ENS + "," + _SQL_FIT_DEDUP + "," + sql_kfold("topic", 7) + """,
fl_dev AS (
  SELECT fs.*, fit.label FROM fs JOIN fit ON fs.arg_id = fit.arg_id AND fs.key_point_id = fit.key_point_id
  JOIN folds d ON fit.topic = d.topic AND fs.fold = d.fold),
fl_test AS (
  SELECT fs.*, l.label FROM fs JOIN lab l ON fs.arg_id = l.arg_id AND fs.key_point_id = l.key_point_id
  WHERE CAST(split_part(fs.arg_id, '_', 2) AS INT) >= 8),
dev AS (SELECT """ + ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRIC_NAMES) + " FROM " + _nested("fl_dev", "fold") + """),
test AS (SELECT """ + ", ".join(f"round(avg({m}), 6) AS {m}_test" for m in metrics.METRIC_NAMES) + " FROM " + _nested("fl_test", "fold") + """),
scored AS (SELECT arg_id, key_point_id, score FROM ens)""" + C.SQL_AP[len(C.SQL_SCORED):] + "," + _SQL_TEST_MAP + """
SELECT 'ensemble_kfold' AS name, -1 AS epoch_stop, 'plain' AS mode, CAST(NULL AS VARCHAR) AS add_info,
       dev.*, test.*, '7 folds' AS model_path, round(mp.s, 6) AS mAP_strict, round(mp.r, 6) AS mAP_relaxed
FROM dev, test, mp""")
def q_kfold_report(spark, sf):
    """The k-fold report row: each fold's scorer measured on its held-out topics (dev) and
    on the test subset (_test), averaged over 7 folds, and the mAP of the ensemble's test
    submission. Labels are joined before the candidates are multiplied by the folds."""
    t = C.tables(spark, sf)
    test = t.subset("test")
    fit = _fit_keys(t)
    own = FO.with_folds(fit, FO.topic_folds(fit, 7).select("topic", "fold"), "topic").select(
        "arg_id", "key_point_id", "label", "fold")
    dev = _fold_scored(t, own)
    lab = t.labels.filter(F.col("subset") == "test").select("arg_id", "key_point_id", "label")
    report, _ = EV.kfold_run("ensemble", _fold_scored(t, subset="test").drop("subset"), test.arguments, test.key_points,
                             test.labels, 7, dev_scored=dev, test_labelled=_fold_scored(t, lab))
    return C.normalised(report)


# ---------------------------------------------------------------- corpus profile

def _all_pairs(t) -> DataFrame:
    return pairs.labelled_pairs(t.arguments, t.key_points, t.labels).drop("subset")


_PAIR_COLS_SQL = ["arg_id", "argument", "key_point_id", "key_point", "topic", "stance", "label"]


@register("corpus_profile", _SQL_PAIRS + """
SELECT count(*) AS n_rows, count(DISTINCT topic) AS n_topics, count(DISTINCT argument) AS n_arguments,
       count(DISTINCT key_point_id) AS n_key_points, count(DISTINCT key_point) AS n_key_point_texts,
       """ + ", ".join(f"count({c}) AS nonnull_{c}" for c in _PAIR_COLS_SQL) + """,
       count(DISTINCT argument) <> count(*) AS dup_argument,
       count(DISTINCT key_point) <> count(*) AS dup_key_point,
       count(DISTINCT topic) <> count(*) AS dup_topic
FROM pairs""")
def q_corpus_profile(spark, sf):
    """A10 + A11 + A24 over the labelled pairs; texts are digested in their own tables."""
    t = C.tables(spark, sf)
    p = pairs.labelled_pairs(PR.digested(t.arguments, "argument"), PR.digested(t.key_points, "key_point"), t.labels)
    return PR.corpus_profile(p.drop("subset"), texts=())


@register("label_counts", _SQL_PAIRS + """
SELECT label, count(*) AS n FROM pairs GROUP BY label""")
def q_label_counts(spark, sf):
    """Label histogram."""
    return PR.label_counts(_all_pairs(C.tables(spark, sf)))


@register("stance_ratio", _SQL_PAIRS + """
SELECT topic, count(CASE WHEN stance = 1 THEN 1 END) AS n_pos,
       count(CASE WHEN stance = -1 THEN 1 END) AS n_neg,
       round(CAST(count(CASE WHEN stance = 1 THEN 1 END) AS DOUBLE)
             / nullif(count(CASE WHEN stance = -1 THEN 1 END), 0), 6) AS ratio
FROM pairs GROUP BY topic""")
def q_stance_ratio(spark, sf):
    """Positive / negative stance rows per topic."""
    return C.normalised(PR.stance_ratio(_all_pairs(C.tables(spark, sf))))


def _sql_len_stats(kind: str, col: str, src: str, length: str) -> str:
    return f"""
SELECT '{kind}' AS kind, count(*) AS n, CAST(min(len) AS BIGINT) AS min_len,
       CAST(max(len) AS BIGINT) AS max_len, CAST(sum(len) AS BIGINT) AS sum_len,
       round(avg(len), 6) AS mean_len
FROM (SELECT {length.format(c='x')} AS len FROM (SELECT DISTINCT {col} AS x FROM {src}))"""


_WORDS_SQL = "len(string_split({c}, ' '))"
_TOKENS_SQL = ("len(list_filter(string_split(regexp_replace(lower({c}), '[^a-zA-Z]', ' ', 'g'), ' '), "
               "lambda w: w <> ''))")


def _len_query(length_sql: str) -> str:
    return ("\nUNION ALL".join([
        _sql_len_stats("argument", "argument", "a", length_sql),
        _sql_len_stats("topic", "topic", "a", length_sql),
        _sql_len_stats("key_point", "key_point", "k", length_sql)]))


def _length_frames(t, fn) -> DataFrame:
    parts = [PR.length_stats(t.arguments.select("argument"), fn, "argument"),
             PR.length_stats(t.arguments.select("topic"), fn, "topic"),
             PR.length_stats(t.key_points.select("key_point"), fn, "key_point")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return C.normalised(out)


@register("text_lengths", "x0 AS (SELECT 1)" + _len_query(_WORDS_SQL))
def q_text_lengths(spark, sf):
    """Word lengths (split on one space) of distinct arguments, topics and key points."""
    return _length_frames(C.tables(spark, sf), TX.word_count)


@register("token_lengths", "x0 AS (SELECT 1)" + _len_query(_TOKENS_SQL))
def q_token_lengths(spark, sf):
    """Token lengths with the default tokenizer (non-empty cleaned words)."""
    return _length_frames(C.tables(spark, sf), PR.token_length)


@register("max_pair_length", _SQL_PAIRS + f"""
SELECT CAST(max({_WORDS_SQL.format(c='argument')} + {_WORDS_SQL.format(c='topic')}) AS BIGINT) AS max_pair_words,
       CAST(max({_TOKENS_SQL.format(c='argument')} + {_TOKENS_SQL.format(c='topic')}) AS BIGINT) AS max_pair_tokens
FROM pairs""")
def q_max_pair_length(spark, sf):
    """Longest argument + topic over the labelled pairs (each argument measured once)."""
    t = C.tables(spark, sf)
    keys = t.labels.select("arg_id", "key_point_id").join(
        t.key_points.select("key_point_id"), "key_point_id")
    return PR.max_pair_length_by_key(keys, t.arguments)


def _sql_hist(kind: str, values: str, density: bool) -> str:
    h = "CAST(coalesce(c.cnt, 0) AS DOUBLE) / (s.n * s.w)" if density else "CAST(coalesce(c.cnt, 0) AS DOUBLE)"
    return f"""
SELECT '{kind}' AS kind, CAST(b.bin + 1 AS INTEGER) AS bin, round(s.lo0 + b.bin * s.w, 6) AS bin_lo,
       round(s.lo0 + (b.bin + 1) * s.w, 6) AS bin_hi, CAST(coalesce(c.cnt, 0) AS BIGINT) AS n,
       round({h}, 6) AS height
FROM (SELECT range AS bin FROM range(10)) b
CROSS JOIN (SELECT *, CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END AS lo0,
                   CASE WHEN hi = lo THEN 0.1 ELSE (hi - lo) / 10 END AS w
            FROM (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM ({values}))) s
LEFT JOIN (
  SELECT CASE WHEN hi = lo THEN 5 ELSE least(floor((v - lo) * 10 / (hi - lo)), 9) END AS bin,
         count(*) AS cnt
  FROM ({values}) CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM ({values}))
  GROUP BY 1) c ON c.bin = b.bin"""


_HIST_ARG = f"SELECT CAST({_WORDS_SQL.format(c='x')} AS DOUBLE) AS v FROM (SELECT DISTINCT argument AS x FROM a)"
_HIST_RATIO = ("SELECT CAST(count(CASE WHEN stance = 1 THEN 1 END) AS DOUBLE) / "
               "nullif(count(CASE WHEN stance = -1 THEN 1 END), 0) AS v FROM pairs GROUP BY topic "
               "HAVING count(CASE WHEN stance = -1 THEN 1 END) > 0")


@register("length_histogram", _SQL_PAIRS + _sql_hist("argument_words", _HIST_ARG, True)
          + "\nUNION ALL" + _sql_hist("stance_ratio", _HIST_RATIO, False))
def q_length_histogram(spark, sf):
    """10-bin histograms: argument word lengths (density) and per-topic stance ratios
    (counts)."""
    t = C.tables(spark, sf)
    lens = PR.distinct_lengths(t.arguments.select("argument"), TX.word_count)
    ratios = PR.stance_ratio(_all_pairs(t)).select("ratio")
    h = PR.histogram(lens, "len", "argument_words", True).unionByName(
        PR.histogram(ratios, "ratio", "stance_ratio", False))
    return C.normalised(h)


@register("label_mean_spread", _SQL_PAIRS + """
SELECT round((SELECT stddev_samp(m) FROM (SELECT avg(label) AS m FROM pairs GROUP BY arg_id)), 6) AS std_arg_id,
       round((SELECT stddev_samp(m) FROM (SELECT avg(label) AS m FROM pairs GROUP BY key_point_id)), 6) AS std_key_point_id,
       round((SELECT stddev_samp(m) FROM (SELECT avg(label) AS m FROM pairs GROUP BY topic)), 6) AS std_topic""")
def q_label_mean_spread(spark, sf):
    """Spread of the mean label per argument, key point and topic."""
    return C.normalised(PR.label_mean_spread(_all_pairs(C.tables(spark, sf))))


# ---------------------------------------------------------------- thresholds (disabled modes)

from ..operators import thresholds as TH  # noqa: E402


def _sql_grid(kind: str, lo: float, hi: float, n: int) -> str:
    x = f"CAST({lo!r} AS DOUBLE) + range * (CAST({hi!r} AS DOUBLE) - CAST({lo!r} AS DOUBLE)) / {n - 1}.0"
    x = f"CASE WHEN range = {n - 1} THEN CAST({hi!r} AS DOUBLE) ELSE {x} END"
    th = f"pow(10.0, {x})" if kind == "log" else x
    return f"g AS (SELECT range AS i, {th} AS th FROM range({n}))"


@register("threshold_f1", _SQL_LABELLED + ",\n" + _sql_grid(*TH.F1_GRID) + """,
P AS (SELECT count(CASE WHEN label = 1 THEN 1 END) AS p FROM labelled),
f AS (
  SELECT g.i, g.th, count(CASE WHEN l.score >= g.th AND l.label = 1 THEN 1 END) AS tp,
         count(CASE WHEN l.score >= g.th THEN 1 END) AS pp
  FROM g CROSS JOIN labelled l GROUP BY g.i, g.th),
f1 AS (SELECT i, th, coalesce(CAST(2 * tp AS DOUBLE) / nullif(pp + p, 0), 0) AS f1 FROM f, P),
best AS (SELECT * FROM f1 ORDER BY f1 DESC, i LIMIT 1)
SELECT round(CASE WHEN f1 > 0 THEN th ELSE -1 END, 6) AS threshold, round(f1, 6) AS f1 FROM best""")
def q_threshold_f1(spark, sf):
    """F1-optimal threshold over np.logspace(-1, 0, 5000) on labelled candidates."""
    return C.normalised(TH.f1_threshold(_labelled(C.tables(spark, sf))))


@register("threshold_youden", _SQL_LABELLED + """,
ps AS (SELECT score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
              count(CASE WHEN label <> 1 THEN 1 END) AS neg FROM labelled GROUP BY score),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM ps WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
j AS (SELECT score, CAST(tp AS DOUBLE) / p AS tpr, CAST(fp AS DOUBLE) / n AS fpr FROM c)
SELECT round(score, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
       round(tpr - fpr, 6) AS youden
FROM j ORDER BY tpr - fpr DESC, score DESC LIMIT 1""")
def q_threshold_youden(spark, sf):
    """Youden threshold argmax(tpr - fpr) on labelled candidates."""
    return C.normalised(TH.youden_threshold(_labelled(C.tables(spark, sf)).select("label", "score")))


@register("predict_stored_threshold", _SQL_LABELLED.replace(
    "SELECT s.*, l.label", "SELECT s.*, CAST(split_part(s.arg_id, '_', 2) AS INT) AS tid, l.label")
    + ",\n" + _sql_grid(*TH.F1_GRID) + """,
dev AS (SELECT * FROM labelled WHERE tid IN (6, 7)),
P AS (SELECT count(CASE WHEN label = 1 THEN 1 END) AS p FROM dev),
f AS (
  SELECT g.i, g.th, count(CASE WHEN l.score >= g.th AND l.label = 1 THEN 1 END) AS tp,
         count(CASE WHEN l.score >= g.th THEN 1 END) AS pp
  FROM g CROSS JOIN dev l GROUP BY g.i, g.th),
f1 AS (SELECT i, th, coalesce(CAST(2 * tp AS DOUBLE) / nullif(pp + p, 0), 0) AS f1 FROM f, P),
best AS (SELECT CASE WHEN f1 > 0 THEN th ELSE -1 END AS th FROM f1 ORDER BY f1 DESC, i LIMIT 1)
SELECT s.arg_id, s.key_point_id, CAST(CASE WHEN s.score >= b.th THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM scored s, best b WHERE CAST(split_part(s.arg_id, '_', 2) AS INT) >= 8""")
def q_predict_stored_threshold(spark, sf):
    """D3: the F1 threshold tuned on dev applied to the test candidates."""
    t = C.tables(spark, sf)
    lab = _labelled(t)
    th = TH.f1_threshold(lab.filter(F.col("subset") == "dev")).select("threshold")
    test = C.scored_candidates(t).filter(F.col("subset") == "test")
    out = TH.apply_threshold(with_scalars(test, th), F.col("threshold"))
    return out.select("arg_id", "key_point_id", "prediction")


@register("predict_best_match", C.SQL_MATCHED + """
SELECT s.arg_id, s.key_point_id,
       CAST(CASE WHEN b.arg_id IS NOT NULL THEN 1 ELSE s.prediction END AS INTEGER) AS prediction
FROM scored s LEFT JOIN best b ON s.arg_id = b.arg_id AND s.key_point_id = b.key_point_id""")
def q_predict_best_match(spark, sf):
    """Argmax prediction, plus the best pair of every argument forced positive."""
    s = C.scored_candidates(C.tables(spark, sf)).select("arg_id", "key_point_id", "score",
                                                        "prediction")
    return TH.force_best_match(s).select("arg_id", "key_point_id", "prediction")


@register("threshold_best_match", _SQL_LABELLED + ",\n" + _sql_grid(*TH.BEST_MATCH_GRID) + """,
lb AS (
  SELECT l.*, row_number() OVER (PARTITION BY arg_id ORDER BY score DESC, key_point_id) = 1 AS best
  FROM labelled l),
base AS (SELECT count(CASE WHEN prediction = 1 AND label = 1 THEN 1 END) AS tp0,
                count(CASE WHEN prediction = 1 THEN 1 END) AS pp0,
                count(CASE WHEN label = 1 THEN 1 END) AS p FROM lb),
fl AS (
  SELECT g.i, g.th,
         count(CASE WHEN lb.best AND lb.prediction <> 1 AND lb.score >= g.th AND lb.label = 1 THEN 1 END) AS tp1,
         count(CASE WHEN lb.best AND lb.prediction <> 1 AND lb.score >= g.th THEN 1 END) AS pp1
  FROM g CROSS JOIN lb GROUP BY g.i, g.th),
f1 AS (SELECT i, th, coalesce(CAST(2 * (tp0 + tp1) AS DOUBLE) / nullif(pp0 + pp1 + p, 0), 0) AS f1
       FROM fl, base)
SELECT round(CASE WHEN f1 > 0 THEN th ELSE -1 END, 6) AS threshold, round(f1, 6) AS f1
FROM f1 ORDER BY f1 DESC, i LIMIT 1""")
def q_threshold_best_match(spark, sf):
    """Best-match-above-threshold mode tuned over np.linspace(0, 0.1, 100)."""
    return C.normalised(TH.best_match_threshold(_labelled(C.tables(spark, sf))))


@register("early_stop_epoch", """
fl AS (
  SELECT p.arg_id, p.key_point_id, l.label, p.l0 / 100.0 AS x0,
         (((p.l1 + 500) * (f.fold + 1)) % 1009 - 500) / 100.0 AS x1, CAST(f.fold AS INTEGER) AS fold,
         CASE WHEN CAST(split_part(p.arg_id, '_', 2) AS INT) <= 5 THEN 'train'
              WHEN CAST(split_part(p.arg_id, '_', 2) AS INT) <= 7 THEN 'dev' ELSE 'test' END AS run
  FROM pred p JOIN lab l ON p.arg_id = l.arg_id AND p.key_point_id = l.key_point_id
  CROSS JOIN (SELECT range AS fold FROM range(7)) f),
hist AS (
  SELECT run, fold + 1 AS epoch,
         avg(greatest(x0, x1) + ln(exp(x0 - greatest(x0, x1)) + exp(x1 - greatest(x0, x1)))
             - CASE WHEN label = 1 THEN x1 ELSE x0 END) AS eval_loss
  FROM fl GROUP BY run, fold),
h1 AS (SELECT *, min(eval_loss) OVER (PARTITION BY run ORDER BY epoch
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM hist),
h2 AS (SELECT *, CASE WHEN bb IS NULL OR (eval_loss < bb AND abs(eval_loss - bb) > 1e-5) THEN 1 ELSE 0 END AS imp FROM h1),
h3 AS (SELECT *, sum(imp) OVER (PARTITION BY run ORDER BY epoch
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM h2),
h4 AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS wait FROM h3),
st AS (SELECT run, coalesce(min(CASE WHEN wait >= 3 THEN epoch END), max(epoch)) AS stop_epoch
       FROM h4 GROUP BY run),
ran AS (SELECT h.run, h.epoch, h.eval_loss, s.stop_epoch FROM h4 h JOIN st s ON h.run = s.run
        WHERE h.epoch <= s.stop_epoch),
rk AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_loss, epoch) AS r,
              count(*) OVER (PARTITION BY run) AS epochs_run FROM ran)
SELECT run, CAST(stop_epoch AS INTEGER) AS stop_epoch, CAST(epoch AS INTEGER) AS best_epoch,
       round(eval_loss, 6) AS best_loss, epochs_run
FROM rk WHERE r = 1""")
def q_early_stop_epoch(spark, sf):
    """Early stopping (patience 3, threshold 1e-5) over per-epoch eval losses derived from
    the fold scorers (run = subset, epoch = fold + 1)."""
    t = C.tables(spark, sf)
    fl = fold_logits(t.logits.join(t.labels.select("arg_id", "key_point_id", "label"),
                                   ["arg_id", "key_point_id"]), 7)
    nll = SC.two_class_nll(F.col("l0") / F.lit(100.0), F.col("l1") / F.lit(100.0), "label")
    hist = fl.groupBy(F.col("subset").alias("run"), (F.col("fold") + 1).cast("int").alias("epoch")
                      ).agg(F.avg(nll).alias("eval_loss"))
    # the history goes through its file format (S8): JSON lines in the shared folder
    path = IO.write_history(hist, IO.scratch_path(spark, "history"))
    return C.normalised(TH.early_stop(IO.read_history(spark, path), patience=3, threshold=1e-5))


# ---------------------------------------------------------------- encoding

from ..operators import encode as ENC  # noqa: E402

MAX_LENGTH = 40
TOPIC_MAX_LENGTH = 10

SQL_WORDS = ("list_filter(string_split(regexp_replace(lower({c}), '[^a-zA-Z]', ' ', 'g'), ' '), "
              "lambda s: s <> '')")

_SQL_VOCAB = f"""
corpus AS (SELECT argument AS x FROM a UNION ALL SELECT key_point AS x FROM k),
cw AS (SELECT unnest({SQL_WORDS.format(c='x')}) AS token FROM corpus),
cnt AS (SELECT token, count(*) AS n FROM cw GROUP BY token),
vr AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS r FROM cnt),
vocab AS (SELECT token, CAST(r - 1 + {ENC.FIRST_WORD_ID} AS INTEGER) AS token_id, n FROM vr)"""


def _corpus(t) -> DataFrame:
    return t.arguments.select(F.col("argument").alias("x")).unionByName(
        t.key_points.select(F.col("key_point").alias("x")))


@register("vocabulary", _SQL_VOCAB + "\nSELECT token, token_id, n FROM vocab")
def q_vocabulary(spark, sf):
    """Corpus vocabulary (all cleaned words) with ids after the specials."""
    return ENC.vocabulary(_corpus(C.tables(spark, sf)), "x")


def _sql_ids(name: str, key: str, text: str, src: str, keep: int) -> str:
    return f"""
{name}_w AS (SELECT {key} AS key, {SQL_WORDS.format(c=text)} AS w FROM {src}),
{name}_x AS (SELECT key, unnest(w[1:{keep}]) AS token, generate_subscripts(w[1:{keep}], 1) AS pos
           FROM {name}_w),
{name}_m AS (SELECT x.key, list(coalesce(v.token_id, {ENC.UNK_ID}) ORDER BY x.pos) AS ids
           FROM {name}_x x LEFT JOIN vocab v ON x.token = v.token GROUP BY x.key),
{name} AS (SELECT w.key, len(w.w) AS n, coalesce(m.ids, CAST([] AS INTEGER[])) AS ids
         FROM {name}_w w LEFT JOIN {name}_m m ON w.key = m.key)"""


_BUDGET = MAX_LENGTH - ENC.PAIR_SPECIALS

_SQL_ENCODED = _SQL_VOCAB + "," + _SQL_PAIRS + "," + _sql_ids("aid", "arg_id", "argument", "a", _BUDGET) + "," + \
    _sql_ids("kid", "key_point_id", "key_point", "k", _BUDGET) + f""",
tr AS (
  SELECT p.arg_id, p.key_point_id, p.label, p.topic, p.stance, ai.ids AS aids, ki.ids AS kids,
         ai.n AS n1, ki.n AS n2, least(ai.n, ki.n) AS sa,
         CASE WHEN least(ai.n, ki.n) > {_BUDGET} THEN least(ai.n, ki.n)
              ELSE greatest(least(ai.n, ki.n), {_BUDGET} - least(ai.n, ki.n)) END AS sb
  FROM pairs p JOIN aid ai ON p.arg_id = ai.key JOIN kid ki ON p.key_point_id = ki.key),
tr2 AS (
  SELECT *, CASE WHEN sa + sb > {_BUDGET} THEN {_BUDGET} // 2 ELSE sa END AS a2,
            CASE WHEN sa + sb > {_BUDGET} THEN {_BUDGET} // 2 + {_BUDGET} % 2 ELSE sb END AS b2
  FROM tr),
tr3 AS (
  SELECT *, CASE WHEN n1 + n2 <= {_BUDGET} THEN n1 WHEN n1 <= n2 THEN a2 ELSE b2 END AS k1,
            CASE WHEN n1 + n2 <= {_BUDGET} THEN n2 WHEN n1 <= n2 THEN b2 ELSE a2 END AS k2
  FROM tr2),
enc AS (
  SELECT arg_id, key_point_id, label, topic, stance,
         list_resize([{ENC.CLS_ID}] || aids[1:k1] || [{ENC.SEP_ID}] || kids[1:k2] || [{ENC.SEP_ID}], {MAX_LENGTH}, {ENC.PAD_ID}) AS ids,
         list_resize(list_resize(CAST([] AS INTEGER[]), k1 + k2 + 3, 1), {MAX_LENGTH}, 0) AS mask,
         list_resize(list_resize(CAST([] AS INTEGER[]), k1 + 2, 0) || list_resize(CAST([] AS INTEGER[]), k2 + 1, 1), {MAX_LENGTH}, 0) AS types
  FROM tr3)"""


def _encoded(t):
    # pair keys only (labels joined to arguments for topic / stance); texts come from their
    # own tables, tokenised once per text
    keys = (t.labels.select("arg_id", "key_point_id", "label")
            .join(t.arguments.select("arg_id", "topic", "stance"), "arg_id")
            .join(t.key_points.select("key_point_id"), "key_point_id"))
    vocab = materialize(ENC.vocabulary(_corpus(t), "x"), "vocabulary")
    enc = ENC.encode_pairs(keys, vocab, MAX_LENGTH,
                           a_texts=t.arguments.select("arg_id", "argument"),
                           b_texts=t.key_points.select("key_point_id", "key_point"))
    return enc, vocab


def _as_text(df: DataFrame) -> DataFrame:
    return df.select("arg_id", "key_point_id", "label",
                     *[F.array_join(c, " ").alias(c) for c in
                       ("input_ids", "attention_mask", "token_type_ids")])


@register("encode_pairs", _SQL_ENCODED + """
SELECT arg_id, key_point_id, label, array_to_string(ids, ' ') AS input_ids,
       array_to_string(mask, ' ') AS attention_mask, array_to_string(types, ' ') AS token_type_ids
FROM enc""")
def q_encode_pairs(spark, sf):
    """[CLS] argument [SEP] key point [SEP], longest-first truncated to 40, padded
    (arrays shown space-joined for the cross-engine check)."""
    enc, _ = _encoded(C.tables(spark, sf))
    return _as_text(enc)


_TOPIC_BUDGET = TOPIC_MAX_LENGTH - ENC.SINGLE_SPECIALS


@register("encode_pairs_topic", _SQL_ENCODED + """,
seg AS (SELECT DISTINCT topic, stance, regexp_replace(lower(topic), '[^a-zA-Z]', ' ', 'g')
               || CASE WHEN stance = 1 THEN ' is positive' ELSE ' is negative' END AS seg_text
        FROM pairs),""" + _sql_ids("sid", "seg_text", "seg_text", "(SELECT DISTINCT seg_text FROM seg)",
                     _TOPIC_BUDGET) + f""",
segenc AS (
  SELECT key AS seg_text,
         list_resize([{ENC.CLS_ID}] || ids || [{ENC.SEP_ID}], {TOPIC_MAX_LENGTH}, {ENC.PAD_ID}) AS sids,
         list_resize(list_resize(CAST([] AS INTEGER[]), len(ids) + 2, 1), {TOPIC_MAX_LENGTH}, 0) AS smask
  FROM sid)
SELECT e.arg_id, e.key_point_id, e.label,
       array_to_string(e.ids || s.sids[2:], ' ') AS input_ids,
       array_to_string(e.mask || s.smask[2:], ' ') AS attention_mask,
       array_to_string(e.types || list_resize(CAST([] AS INTEGER[]), {TOPIC_MAX_LENGTH - 1}, 0), ' ') AS token_type_ids
FROM enc e JOIN seg g ON e.topic = g.topic AND e.stance = g.stance
JOIN segenc s ON g.seg_text = s.seg_text""")
def q_encode_pairs_topic(spark, sf):
    """E5: the pair encoding with the topic + stance segment (max_length 10) appended."""
    t = C.tables(spark, sf)
    enc, vocab = _encoded(t)
    seg_text = F.concat(TX.clean_text("topic"), TX.stance_text("stance"))
    # the arguments' own topics and stances: the encoded pairs are not planned a second time
    segs = t.arguments.select("topic", "stance").distinct().withColumn("seg_text", seg_text)
    seg_enc = ENC.encode_single(segs.select("seg_text").distinct(), "seg_text", "seg_text",
                                vocab, TOPIC_MAX_LENGTH)
    seg_map = segs.join(seg_enc, "seg_text").drop("seg_text")
    out = ENC.append_segment(enc, seg_map, ["topic", "stance"])
    return _as_text(out)


# ---------------------------------------------------------------- sources / sinks, model, stream

from ..operators import model as MD  # noqa: E402
from ..sources import io as IO  # noqa: E402
from ..streaming.matching import start_best_match_stream  # noqa: E402


@register("submission_map", C.SQL_SCORED + """
SELECT arg_id, count(*) AS n_key_points,
       string_agg(key_point_id, ',' ORDER BY key_point_id) AS key_points,
       round(sum(score), 6) AS score_sum
FROM scored GROUP BY arg_id""")
def q_submission_map(spark, sf):
    """One submission row per argument, map key_point_id -> score with sorted keys
    (shown as its size, its keys and the sum of its scores)."""
    t = C.tables(spark, sf)
    sub = IO.submission_frame(C.scored_candidates(t))
    return C.normalised(sub.select(
        "arg_id", F.size("key_points").cast("long").alias("n_key_points"),
        F.array_join(F.map_keys("key_points"), ",").alias("key_points"),
        F.aggregate(F.map_values("key_points"), F.lit(0.0), lambda acc, x: acc + x).alias("score_sum")))


@register("submission_explode", C.SQL_SCORED + """
SELECT arg_id, key_point_id, round(score, 6) AS score FROM scored""")
def q_submission_explode(spark, sf):
    """S4 -> S5 round trip: the submission written as JSON lines to the shared checkpoint
    folder, read back and flattened to (arg_id, key_point_id, score)."""
    t = C.tables(spark, sf)
    path = IO.write_submission(C.scored_candidates(t), IO.scratch_path(spark, "submission"))
    return C.normalised(IO.read_submission(spark, path))


_REPORT_SQL = _SQL_LABELLED.replace(
    "SELECT s.*, l.label", "SELECT s.*, CASE WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 5 "
    "THEN 'train' WHEN CAST(split_part(s.arg_id, '_', 2) AS INT) <= 7 THEN 'dev' ELSE 'test' END "
    "AS subset, l.label") + _sql_metrics("labelled", "subset", "", rounded=False).rstrip() + ",\n" + \
    C.SQL_AP[len(C.SQL_SCORED) + 2:] + """,
mp AS (SELECT avg(ap_strict) AS mAP_strict, avg(ap_relaxed) AS mAP_relaxed FROM ap)
SELECT m.subset AS name,
       """ + ", ".join(f"printf('%.5f', {c})" + f" AS {c}" for c in metrics.METRIC_NAMES) + """,
       CASE WHEN m.subset = 'test' THEN printf('%.5f', mp.mAP_strict) ELSE '-1.00000' END AS mAP_strict,
       CASE WHEN m.subset = 'test' THEN printf('%.5f', mp.mAP_relaxed) ELSE '-1.00000' END AS mAP_relaxed
FROM metrics m, mp"""

_REPORT_VALUES = [*metrics.METRIC_NAMES, "mAP_strict", "mAP_relaxed"]


@register("report_file", _REPORT_SQL.replace("\nSELECT m.subset AS name", ",\nrep AS (SELECT m.subset AS name")
          + ")\nSELECT name, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _REPORT_VALUES) + " FROM rep")
def q_report_file(spark, sf):
    """S7 as a file: the report written, read back, upserted with a new 'test' row, written to
    a new folder and read again (missing values are -1 in the file)."""
    t = C.tables(spark, sf)
    lab = _labelled(t)
    old = metrics.binary_metrics(lab, group_cols=["subset"]).withColumnRenamed("subset", "name")
    path = IO.write_report(old, IO.scratch_path(spark, "report"))
    new = with_scalars(metrics.binary_metrics(lab.filter(F.col("subset") == "test")),
                       metrics.mean_average_precision(_matched(t))).select(F.lit("test").alias("name"), "*")
    merged = IO.report_upsert(IO.read_report(spark, path), new)
    back = IO.read_report(spark, IO.write_report(merged, IO.scratch_path(spark, "report")))
    return C.normalised(back.select("name", *_REPORT_VALUES))


@register("report_upsert", _REPORT_SQL)
def q_report_upsert(spark, sf):
    """A report keyed by name (one row per subset) upserted with a new 'test' row that
    adds mAP columns; old rows show -1 in the new columns, floats as %.5f."""
    t = C.tables(spark, sf)
    lab = _labelled(t)
    old = metrics.binary_metrics(lab, group_cols=["subset"]).withColumnRenamed("subset", "name")
    test_m = metrics.binary_metrics(lab.filter(F.col("subset") == "test"))
    mAP = metrics.mean_average_precision(_matched(t))
    new = with_scalars(test_m, mAP).select(F.lit("test").alias("name"), "*")
    return IO.report_export_frame(IO.report_upsert(old, new))




def _sql_run(fmt: str) -> str:
    """The metrics of a run: dev, test and the test submission's mAP, each through ``fmt``."""
    one = lambda c, name: fmt.format(c) + f" AS {name}"
    return _SQL_LABELLED + """,
dev_l AS (SELECT * FROM labelled WHERE CAST(split_part(arg_id, '_', 2) AS INT) IN (6, 7)),
test_l AS (SELECT * FROM labelled WHERE CAST(split_part(arg_id, '_', 2) AS INT) >= 8),
""" + C.SQL_AP[len(C.SQL_SCORED) + 2:] + "," + _SQL_TEST_MAP + """,
dev AS (SELECT """ + ", ".join(one(m, m) for m in metrics.METRIC_NAMES) + " FROM " + _nested("dev_l", None) + """),
test AS (SELECT """ + ", ".join(one(m, f"{m}_test") for m in metrics.METRIC_NAMES) + " FROM " + _nested("test_l", None) + """),
best_map AS (SELECT """ + one("s", "mAP_strict") + ", " + one("r", "mAP_relaxed") + " FROM mp)"


@register("run_report", _sql_run("round({}, 6)") + """
SELECT 'fixture_scorer' AS name, -1 AS epoch_stop, 'plain' AS mode, CAST(NULL AS VARCHAR) AS add_info,
       dev.*, test.*, best_map.*, 'fixture' AS model_path FROM dev, test, best_map""")
def q_run_report(spark, sf):
    """M5: the single-run report row: dev metrics, test metrics (_test) and the test-subset
    submission mAP, from the fixture scorer."""
    t = C.tables(spark, sf)
    s = C.scored_candidates(t)
    dev, test = t.subset("dev"), t.subset("test")
    row = EV.evaluate_run("fixture_scorer", s.filter(F.col("subset") == "dev"), dev.labels,
                          s.filter(F.col("subset") == "test"), test.arguments, test.key_points,
                          test.labels, model_path="fixture")
    return C.normalised(row)


@register("run_experiment", _sql_run("CAST(printf('%.5f', {}) AS DOUBLE)") + """,
pr AS (SELECT count(*) AS n_predictions, CAST(sum(prediction) AS BIGINT) AS n_positive FROM scored
       WHERE CAST(split_part(arg_id, '_', 2) AS INT) >= 8)
SELECT v.name, dev.*, test.*, best_map.*, pr.* FROM dev, test, best_map, pr, (VALUES ('first'), ('second')) v(name)""")
def q_run_experiment(spark, sf):
    """M5 with its sinks: two runs, the second upserting the first's report file; the report
    read back, next to the rows of the prediction file and the pairs of the submission."""
    from ..sources.schemas import PREDICTION_SCHEMA
    t = C.tables(spark, sf)
    s = C.scored_candidates(t)
    dev, test = t.subset("dev"), t.subset("test")
    paths: dict[str, str] = {}
    for name in ("first", "second"):
        paths = EV.run_experiment(
            IO.scratch_path(spark, f"run-{name}"), name, s.filter(F.col("subset") == "dev"), dev.labels,
            s.filter(F.col("subset") == "test"), test.arguments, test.key_points, test.labels,
            report_path=paths.get("report"), model_path="fixture")
    schema = T.StructType([PREDICTION_SCHEMA[c] for c in ("arg_id", "key_point_id", "prediction")])
    pred = IO.read_predictions(spark, paths["predictions"], schema)
    sent = IO.read_submission(spark, paths["submission"]).select("arg_id", "key_point_id")
    files = pred.join(sent, ["arg_id", "key_point_id"]).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.sum("prediction").cast("long").alias("n_positive"))
    rows = IO.read_report(spark, paths["report"]).drop("epoch_stop", "mode", "add_info", "model_path")
    return C.normalised(with_scalars(rows, files))


@register("pair_features", _SQL_PAIRS + f""",
w AS (SELECT arg_id, key_point_id, label, list_distinct({SQL_WORDS.format(c='argument')}) AS wa,
             list_distinct({SQL_WORDS.format(c='key_point')}) AS wb FROM pairs),
s AS (SELECT *, len(list_intersect(wa, wb)) AS n FROM w)
SELECT arg_id, key_point_id, len(wa) + len(wb) + n AS n_tokens, CAST(n AS DOUBLE) AS n_shared,
       round(coalesce(CAST(n AS DOUBLE) / nullif(len(wa) + len(wb) - n, 0), 0), 6) AS jaccard,
       round(ln(1.0 + len(wa)), 6) AS log_len_a, round(ln(1.0 + len(wb)), 6) AS log_len_b,
       CAST(CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS weight FROM s""")
def q_pair_features(spark, sf):
    """M1 + M2: the classifier's inputs: words of both texts and shared words, overlap numbers,
    and the class weight of every labelled pair."""
    t = C.tables(spark, sf)
    x = MD.pair_features(t.labels.select("arg_id", "key_point_id", "label"), t.arguments.select("arg_id", "argument"),
                         t.key_points.select("key_point_id", "key_point"))
    return C.normalised(x.select(
        "arg_id", "key_point_id", F.size("tokens").cast("long").alias("n_tokens"), "n_shared", "jaccard",
        "log_len_a", "log_len_b", MD.class_weight("label", 2.0).alias("weight")))


@register("model_scores")
def q_model_scores(spark, sf):
    """M1-M3: a class-weighted logistic-regression pair classifier on hashed words, fitted on the
    train pairs, scores every test candidate (iterative fit: rows-only check; the fit that SQL can
    recompute is ``pair_newton_fit``). Each subset's texts are tokenised once."""
    t = C.tables(spark, sf)
    train, test = t.subset("train"), t.subset("test")
    model = MD.fit(train.labels.select("arg_id", "key_point_id", "label"), pos_weight=2.0,
                   arguments=train.arguments, key_points=train.key_points)
    cands = pairs.candidate_ids(test.arguments, test.key_points).filter(F.col("key_point_id").isNotNull())
    return C.normalised(MD.score(model, cands, arguments=test.arguments, key_points=test.key_points))


@register("stream_best_match", C.SQL_MATCHED + """
SELECT arg_id, key_point_id, round(score, 6) AS score FROM best""")
def q_stream_best_match(spark, sf):
    """Streaming: documents as a file stream -> arguments -> candidates with static key points
    -> scores -> best match per argument in each micro-batch, written to the shared folder."""
    out = IO.scratch_path(spark, "stream-best")
    q = start_best_match_stream(spark, sf, out + "/data", out + "/checkpoint")
    q.awaitTermination()
    return C.normalised(spark.read.parquet(out + "/data").select("arg_id", "key_point_id", "score"))



@register("task_tables_csv", """
SELECT l.arg_id, a.argument, l.key_point_id, CASE WHEN a.tid >= 8 THEN concat('submitted: ', k.key_point) ELSE k.key_point END AS key_point,
       a.topic, a.stance, l.label
FROM lab l JOIN a ON l.arg_id = a.arg_id JOIN k ON l.key_point_id = k.key_point_id""")
def q_task_tables_csv(spark, sf):
    """S1 + S2 + S3: every subset written as the task's three CSV files (test under test_data,
    train / dev under kpm_data), loaded back with explicit schemas through the subset routing
    (the test key points from a submitted file with other texts, in place of the gold one) and
    joined into the labelled pairs. Texts with quotes and line breaks survive the round trip."""
    t = C.tables(spark, sf)
    root = IO.scratch_path(spark, "task-csv")
    parts = []
    for sub in ("train", "dev", "test"):
        x = t.subset(sub)
        IO.write_task_tables(x.arguments.drop("subset"), x.key_points.drop("subset"),
                             x.labels.drop("subset"), IO.subset_dir(root, sub), sub)
    kps = t.subset("test").key_points.drop("subset")
    submitted = IO.write_key_points(kps.withColumn("key_point", F.concat(F.lit("submitted: "), "key_point")),
                                    IO.scratch_path(spark, "submitted-key-points"))
    for sub in ("train", "dev", "test"):
        override = submitted if sub == "test" else None
        a, k, lab = IO.load_task_tables(spark, root=root, subset=sub, submitted_kp_file=override)
        parts.append(pairs.labelled_pairs(a, k, lab))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("prediction_csv", C.SQL_SCORED + """
SELECT arg_id, key_point_id, prediction FROM scored""")
def q_prediction_csv(spark, sf):
    """The prediction file (arg_id, key_point_id, prediction) written as CSV to the shared
    folder and read back."""
    from ..sources.schemas import PREDICTION_SCHEMA
    t = C.tables(spark, sf)
    path = IO.write_predictions(C.scored_candidates(t), IO.scratch_path(spark, "predictions"))
    schema = T.StructType([PREDICTION_SCHEMA[c] for c in ("arg_id", "key_point_id", "prediction")])
    return IO.read_predictions(spark, path, schema)


_SQL_TOK = ("list_concat(list_transform(kw.wb, lambda w: 'b:' || w), "
            "list_transform(list_intersect(aw.wa, kw.wb), lambda w: 's:' || w))")


@register("naive_bayes_kfold_ensemble", f"""
aw AS (SELECT arg_id, list_distinct({SQL_WORDS.format(c='argument')}) AS wa FROM a),
kw AS (SELECT key_point_id, list_distinct({SQL_WORDS.format(c='key_point')}) AS wb FROM k),
fitp AS (SELECT l.arg_id, l.key_point_id, l.label, a.topic FROM lab l JOIN a ON l.arg_id = a.arg_id
         WHERE a.tid <= 7),""" + sql_kfold("topic", 7, "fitp") + f""",
trows AS (SELECT f.arg_id, f.key_point_id, f.label, d.fold FROM fitp f JOIN folds d ON f.topic = d.topic),
ttok AS (SELECT t.label, t.fold, unnest({_SQL_TOK}) AS token
         FROM trows t JOIN aw ON t.arg_id = aw.arg_id JOIN kw ON t.key_point_id = kw.key_point_id),
c AS (SELECT fold, token, count(CASE WHEN label = 1 THEN 1 END) AS n1,
             count(CASE WHEN label <> 1 THEN 1 END) AS n0 FROM ttok GROUP BY fold, token),
tot AS (SELECT token, sum(n1) AS t1, sum(n0) AS t0 FROM c GROUP BY token),
lo AS (SELECT tot.token, g.target, tot.t1 - coalesce(c.n1, 0) AS n1, tot.t0 - coalesce(c.n0, 0) AS n0
       FROM tot CROSS JOIN (SELECT range AS target FROM range(7)) g
       LEFT JOIN c ON c.token = tot.token AND c.fold = g.target),
lo2 AS (SELECT * FROM lo WHERE n1 + n0 > 0),
st AS (SELECT target, sum(n1) AS big1, sum(n0) AS big0, count(*) AS v FROM lo2 GROUP BY target),
w AS (SELECT lo2.target, lo2.token,
             ln((lo2.n1 + 1.0) / (st.big1 + 1.0 * st.v)) - ln((lo2.n0 + 1.0) / (st.big0 + 1.0 * st.v)) AS w
      FROM lo2 JOIN st ON lo2.target = st.target),
rc AS (SELECT fold, count(CASE WHEN label = 1 THEN 1 END) AS r1,
              count(CASE WHEN label <> 1 THEN 1 END) AS r0 FROM trows GROUP BY fold),
pri AS (SELECT g.target, ln((sum(CASE WHEN rc.fold <> g.target THEN r1 ELSE 0 END) + 1.0)
                            / (sum(CASE WHEN rc.fold <> g.target THEN r0 ELSE 0 END) + 1.0)) AS prior
        FROM (SELECT range AS target FROM range(7)) g CROSS JOIN rc GROUP BY g.target),
cand AS (SELECT a.arg_id, k.key_point_id FROM a JOIN k ON a.topic = k.topic AND a.stance = k.stance
         AND a.tid = k.tid WHERE a.tid >= 8),
ctok AS (SELECT c.arg_id, c.key_point_id, unnest({_SQL_TOK}) AS token
         FROM cand c JOIN aw ON c.arg_id = aw.arg_id JOIN kw ON c.key_point_id = kw.key_point_id),
sw AS (SELECT ct.arg_id, ct.key_point_id, w.target, sum(w.w) AS s
       FROM ctok ct JOIN w ON ct.token = w.token GROUP BY ct.arg_id, ct.key_point_id, w.target),
lg AS (SELECT c.arg_id, c.key_point_id, p.target, p.prior + coalesce(sw.s, 0) AS logit
       FROM cand c CROSS JOIN pri p
       LEFT JOIN sw ON sw.arg_id = c.arg_id AND sw.key_point_id = c.key_point_id AND sw.target = p.target)
SELECT arg_id, key_point_id, round(avg(1.0 / (1.0 + exp(-logit))), 6) AS score, count(*) AS n_folds,
       CAST(max(CASE WHEN target = 0 AND logit > 0 THEN 1 ELSE 0 END) AS INTEGER) AS prediction
FROM lg GROUP BY arg_id, key_point_id""")
def q_naive_bayes_kfold_ensemble(spark, sf):
    """M4 + J9: seven naive-Bayes pair models, model f trained on the train + dev pairs of
    every topic fold but f (one pass of leave-one-fold-out counts), score every test
    candidate; the ensemble is the mean score per pair, the prediction that of fold 0."""
    t = C.tables(spark, sf)
    # an argument's subset follows from its id, so either side tokenises its own texts only
    own = {side: t.arguments.filter(f).select("arg_id", "argument") for side, f in
           (("fit", F.col("subset") != "test"), ("test", F.col("subset") == "test"))}
    tk = t.key_points.select("key_point_id", "key_point")
    fit = (t.labels.filter(F.col("subset") != "test").select("arg_id", "key_point_id", "label")
           .join(t.arguments.select("arg_id", "topic"), "arg_id"))
    folds_t = FO.topic_folds(fit, 7)
    rows = FO.with_folds(fit, folds_t.select("topic", "fold"), "topic")
    train_tokens = MD.pair_tokens(rows, own["fit"], tk, extra=("label", "fold"))
    test = t.subset("test")
    cands = pairs.candidate_ids(test.arguments, test.key_points).filter(
        F.col("key_point_id").isNotNull())
    fs = MD.naive_bayes_kfold(train_tokens, rows, MD.pair_tokens(cands, own["test"], tk), 7)
    return C.normalised(EN.ensemble_scores(fs))


def _shared_word_scorer():
    """Stand-in outside model for the M3 extension point: logit l1 = number of distinct
    cleaned words shared by argument and key point (l0 = 0). Loaded once per task."""
    import pandas as pd

    def score(batch: "pd.DataFrame") -> "pd.DataFrame":
        a = batch["argument_clean"].str.split()
        b = batch["key_point_clean"].str.split()
        shared = [float(len(set(x) & set(y))) for x, y in zip(a, b)]
        return pd.DataFrame({"l0": [0.0] * len(shared), "l1": shared})
    return score


@register("outside_scorer_scores", f"""
cand AS (SELECT a.arg_id, k.key_point_id FROM a JOIN k ON a.topic = k.topic AND a.stance = k.stance
         AND a.tid = k.tid),
sh AS (SELECT c.arg_id, c.key_point_id,
              CAST(len(list_intersect(list_distinct({SQL_WORDS.format(c='a.argument')}),
                                      list_distinct({SQL_WORDS.format(c='k.key_point')}))) AS DOUBLE) AS l1
       FROM cand c JOIN a ON c.arg_id = a.arg_id JOIN k ON c.key_point_id = k.key_point_id)
SELECT arg_id, key_point_id, CAST(0.0 AS DOUBLE) AS l0, l1, round(1.0 / (1.0 + exp(-l1)), 6) AS score FROM sh""")
def q_outside_scorer_scores(spark, sf):
    """M3 extension point: every candidate pair scored by an outside scorer through
    ``mapInPandas`` (Arrow batches, one scorer load per task); texts cleaned once per key."""
    from ..operators.scoring import score_with
    t = C.tables(spark, sf)
    cands = pairs.candidate_ids(t.arguments, t.key_points).filter(
        F.col("key_point_id").isNotNull()).select("arg_id", "key_point_id")
    texts = pairs.pair_text_by_key(cands, t.arguments, t.key_points)
    logits = score_with(texts, _shared_word_scorer)
    return C.normalised(logits.withColumn("score", SC.positive_softmax("l0", "l1")))


from . import catalog_models  # noqa: E402, F401
from . import catalog_scale  # noqa: E402, F401
