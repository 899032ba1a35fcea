"""Registered queries of the Newton-fitted pair classifier (M1, M2, M4) and their DuckDB SQL: the
Newton steps are a recursive table there, each solving its system by Cholesky factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as EN
from ..operators import folds as FO
from ..operators import newton as NW
from ..operators import pairs
from . import common as C
from .catalog import ORACLE, SQL_WORDS, register, sql_kfold


def _sql_solve(src: str, d: int, reg: float) -> str:
    """Adds s0 .. s{d-1}, the solution of the ridge system, to the sums in ``src``."""
    ridge = lambda i: f" + {reg!r} * c" if i else ""
    q = src
    for j in range(d):                        # factor L, a column at a time
        diag = f"sqrt(h{j}_{j}{ridge(j)}" + "".join(f" - l{j}_{m} * l{j}_{m}" for m in range(j)) + f") AS l{j}_{j}"
        q = f"(SELECT *, {diag} FROM {q})"
        below = [f"(h{j}_{i}" + "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j)) + f") / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, d)]
        q = f"(SELECT *, {', '.join(below)} FROM {q})" if below else q
    for i in range(d):                        # L z = g
        g = f"(g{i}" + (f" - {reg!r} * c * w{i}" if i else "") + "".join(f" - l{i}_{m} * z{m}" for m in range(i)) + f") / l{i}_{i}"
        q = f"(SELECT *, {g} AS z{i} FROM {q})"
    for i in reversed(range(d)):              # L' s = z
        s = f"(z{i}" + "".join(f" - l{m}_{i} * s{m}" for m in range(i + 1, d)) + f") / l{i}_{i}"
        q = f"(SELECT *, {s} AS s{i} FROM {q})"
    return q


def sql_newton(rows: str, models: int, d: int = 1 + len(NW.FEATURES), steps: int = NW.STEPS, reg: float = NW.REG) -> str:
    """The recursive table ``it`` (step, model, w0, ...) over ``rows`` (fold, y, c, x0, x1, ...)."""
    w = ", ".join(f"w{i}" for i in range(d))
    z = " + ".join(f"w{i} * x{i}" for i in range(d))
    sums = [f"sum(c * (y - p) * x{i}) AS g{i}" for i in range(d)] + [
        f"sum(c * p * (1 - p) * x{i} * x{j}) AS h{i}_{j}" for i in range(d) for j in range(i, d)]
    met = (f"(SELECT it.*, r.y, r.c, {', '.join(f'r.x{i}' for i in range(d))}, 1.0 / (1.0 + exp(-({z}))) AS p "
           f"FROM it JOIN {rows} r ON r.fold <> it.model WHERE it.step < {steps})")
    src = f"(SELECT step, model, {w}, sum(c) AS c, {', '.join(sums)} FROM {met} GROUP BY step, model, {w})"
    return f"""
it AS (
  SELECT 0 AS step, CAST(range AS INT) AS model, {', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in range(d))} FROM range({models})
  UNION ALL
  SELECT step + 1, model, {', '.join(f'w{i} + s{i}' for i in range(d))} FROM {_sql_solve(src, d, reg)})"""


_SQL_TEXT_WORDS = f"""
aw AS MATERIALIZED (SELECT arg_id, topic, stance, tid, list_distinct({SQL_WORDS.format(c='argument')}) AS wa FROM a),
kw AS MATERIALIZED (SELECT key_point_id, topic, stance, tid, list_distinct({SQL_WORDS.format(c='key_point')}) AS wb FROM k)"""


def _sql_features(cols: str, src: str) -> str:
    """Feature columns x0 .. x4 of the pairs in ``src`` (joined with aw and kw)."""
    return f"""(SELECT {cols}, CAST(1 AS DOUBLE) AS x0, CAST(n AS DOUBLE) AS x1,
        coalesce(CAST(n AS DOUBLE) / nullif(len(wa) + len(wb) - n, 0), 0) AS x2, ln(1.0 + len(wa)) AS x3, ln(1.0 + len(wb)) AS x4
 FROM (SELECT *, len(list_intersect(wa, wb)) AS n FROM {src}))"""


def _recursive(body: str) -> str:
    return C.sql(body).replace("WITH ", "WITH RECURSIVE ", 1)


def _texts(t):
    return t.arguments.select("arg_id", "argument"), t.key_points.select("key_point_id", "key_point")


@register("pair_newton_fit")
def q_pair_newton_fit(spark, sf):
    """M1 + M2: the weights of the pair classifier on the dense overlap features, fitted on the
    train pairs with positives weighted 2."""
    t = C.tables(spark, sf)
    train = t.labels.filter(F.col("subset") == "train").select("arg_id", "key_point_id", "label")
    x = NW.overlap_features(train, *_texts(t))
    return C.normalised(NW.weights_frame(x, NW.fit(x, pos_weight=2.0)))


ORACLE["pair_newton_fit"] = _recursive(_SQL_TEXT_WORDS + """,
rows AS MATERIALIZED (SELECT -1 AS fold, CAST(label AS DOUBLE) AS y, CASE WHEN label = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS c, x0, x1, x2, x3, x4
         FROM """ + _sql_features("label", "(SELECT l.label, aw.wa, kw.wb FROM lab l JOIN aw USING (arg_id) JOIN kw USING (key_point_id) WHERE aw.tid <= 5)") + "),"
    + sql_newton("rows", 1) + f"""
SELECT unnest(['{NW.INTERCEPT}', {', '.join(f"'{f}'" for f in NW.FEATURES)}]) AS feature,
       unnest([round(w0, 6), round(w1, 6), round(w2, 6), round(w3, 6), round(w4, 6)]) AS weight FROM it WHERE step = {NW.STEPS}""")


@register("model_kfold_ensemble")
def q_model_kfold_ensemble(spark, sf):
    """M4 + J9: seven Newton-fitted pair models, model f trained on the train + dev pairs of every
    topic fold but f, all in one pass a step, score every test candidate; the ensemble is the mean
    score per pair, the prediction that of fold 0."""
    t = C.tables(spark, sf)
    fit = (t.labels.filter(F.col("subset") != "test").select("arg_id", "key_point_id", "label")
           .join(t.arguments.select("arg_id", "topic"), "arg_id"))
    rows = FO.with_folds(fit, FO.topic_folds(fit, 7).select("topic", "fold"), "topic")
    weights = NW.fit_folds(NW.overlap_features(rows.select("arg_id", "key_point_id", "label", "fold"), *_texts(t)), 7)
    test = t.subset("test")
    cands = pairs.candidate_ids(test.arguments, test.key_points).filter(F.col("key_point_id").isNotNull())
    x = NW.overlap_features(cands.select("arg_id", "key_point_id"), *_texts(test))
    return C.normalised(EN.ensemble_scores(NW.score_folds(x, weights)))


ORACLE["model_kfold_ensemble"] = _recursive(_SQL_TEXT_WORDS + """,
fitp AS (SELECT l.arg_id, l.key_point_id, l.label, a.topic FROM lab l JOIN a ON l.arg_id = a.arg_id WHERE a.tid <= 7),"""
    + sql_kfold("topic", 7, "fitp") + """,
rows AS MATERIALIZED (SELECT fold, CAST(label AS DOUBLE) AS y, 1.0::DOUBLE AS c, x0, x1, x2, x3, x4 FROM """
    + _sql_features("label, fold", """(SELECT f.label, d.fold, aw.wa, kw.wb FROM fitp f JOIN folds d ON f.topic = d.topic
           JOIN aw ON f.arg_id = aw.arg_id JOIN kw ON f.key_point_id = kw.key_point_id)""") + "),"
    + sql_newton("rows", 7) + """,
cand AS (SELECT * FROM """
    + _sql_features("arg_id, key_point_id", """(SELECT aw.arg_id, kw.key_point_id, aw.wa, kw.wb FROM aw JOIN kw
           ON aw.topic = kw.topic AND aw.stance = kw.stance AND aw.tid = kw.tid WHERE aw.tid >= 8)""") + f"""),
lg AS (SELECT arg_id, key_point_id, model, w0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4 AS logit
       FROM cand CROSS JOIN (SELECT * FROM it WHERE step = {NW.STEPS}))
SELECT arg_id, key_point_id, round(avg(1.0 / (1.0 + exp(-logit))), 6) AS score, count(*) AS n_folds,
       CAST(max(CASE WHEN model = 0 AND logit > 0 THEN 1 ELSE 0 END) AS INTEGER) AS prediction
FROM lg GROUP BY arg_id, key_point_id""")
