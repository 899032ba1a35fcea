"""Registered queries of the operators made for skew, growth and interruption, and of the one-call
entries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as ENC
from ..operators import ensemble as EN
from ..operators import metrics, pairs
from ..operators import profile as PR
from ..operators import subwords as SW
from ..operators.sizing import materialize, with_scalars
from ..sources import io as IO
from ..sources.schemas import PAIR_COLS
from . import catalog as Q
from . import common as C
from . import evaluate as EV
from .catalog import ORACLE, SQL_WORDS, register

CELL = 50         # rows of a side in one cell of the registered grid join: every side is cut


@register("candidate_pairs_grid")
def q_candidate_pairs_grid(spark, sf):
    """J3 by a two-sided grid: the rows of ``candidate_pairs``, each side's pairs cut into cells."""
    t = C.tables(spark, sf)
    ids = pairs.candidate_ids(t.arguments, t.key_points, cell=CELL)
    x = (ids.join(t.arguments.select("arg_id", "argument"), "arg_id")
         .join(t.key_points.select("key_point_id", "key_point"), "key_point_id", "left"))
    return x.withColumn("label", F.lit(None).cast("int")).select(*PAIR_COLS)


ORACLE["candidate_pairs_grid"] = ORACLE["candidate_pairs"]


SKETCHED = ("topic", "argument", "key_point_id", "key_point")
_SQL_SUBSET = "CASE WHEN tid <= 5 THEN 'train' WHEN tid <= 7 THEN 'dev' ELSE 'test' END"
_SQL_SKETCH = f"""
p AS (SELECT a.tid, {_SQL_SUBSET.replace('tid', 'a.tid')} AS subset, a.topic, a.argument, l.key_point_id, k.key_point
      FROM lab l JOIN a ON l.arg_id = a.arg_id JOIN k ON l.key_point_id = k.key_point_id),
u AS (SELECT subset, topic, argument, key_point_id, key_point FROM p UNION ALL SELECT 'all', topic, argument, key_point_id, key_point FROM p)
SELECT subset, count(*) AS n_rows, {', '.join(f'count({c}) AS nonnull_{c}, TRUE AS near_{c}' for c in SKETCHED)} FROM u GROUP BY subset"""


@register("corpus_profile_sketch", _SQL_SKETCH)
def q_corpus_profile_sketch(spark, sf):
    """A10 + A11 as a mergeable profile: a sketch per subset, the subsets' sketches united into the
    whole, and whether each estimate lies within the sketch's error bound of the exact count."""
    t = C.tables(spark, sf)
    p = materialize(pairs.labelled_pairs(PR.digested(t.arguments, "argument"), PR.digested(t.key_points, "key_point"), t.labels), "profile-pairs")
    each = materialize(PR.sketch_profile(p, SKETCHED, ["subset"]), "profile")
    whole = PR.merge_profiles(each).withColumn("subset", F.lit("all"))
    estimates = PR.profile_estimates(each.unionByName(whole))
    exact = [F.count_distinct(c).alias(f"exact_{c}") for c in SKETCHED]
    counts = p.groupBy("subset").agg(*exact).unionByName(p.agg(*exact).withColumn("subset", F.lit("all")))
    near = lambda c: (F.abs(F.col(f"distinct_{c}") - F.col(f"exact_{c}"))
                      <= F.greatest(F.lit(1.0), F.lit(PR.error_bound()) * F.col(f"exact_{c}"))).alias(f"near_{c}")
    return estimates.join(counts, "subset").select("subset", "n_rows", *[x for c in SKETCHED for x in (F.col(f"nonnull_{c}"), near(c))])


_INFO = {"arg_id": "string", "argument": "string", "key_point_id": "string", "key_point": "string", "topic": "string",
         "stance": "int", "label": "int"}


@register("frame_info", """
p AS (SELECT l.arg_id, a.argument, l.key_point_id, k.key_point, a.topic, a.stance, l.label
      FROM lab l JOIN a ON l.arg_id = a.arg_id JOIN k ON l.key_point_id = k.key_point_id)
""" + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS place, '{c}' AS column_name, count({c}) AS non_null, '{t}' AS dtype FROM p"
                         for i, (c, t) in enumerate(_INFO.items())))
def q_frame_info(spark, sf):
    """Columns, non-null counts and types of the labelled pairs."""
    t = C.tables(spark, sf)
    return PR.frame_info(pairs.labelled_pairs(t.arguments, t.key_points, t.labels).drop("subset"))


@register("ensemble_golden_labels", Q._SQL_ENS + """
SELECT e.arg_id, e.key_point_id, round(e.score, 6) AS score, e.n_folds, e.prediction, l.label AS golden_label
FROM ens e JOIN lab l ON e.arg_id = l.arg_id AND e.key_point_id = l.key_point_id""")
def q_ensemble_golden_labels(spark, sf):
    """The ensemble over 7 fold scorers with prediction and golden label of fold 0."""
    t = C.tables(spark, sf)
    folds = Q._fold_scored(t, t.labels.select("arg_id", "key_point_id", "label")).withColumnRenamed("label", "golden_label")
    return C.normalised(EN.ensemble_scores(folds, ("prediction", "golden_label")))


@register("ensemble_resumed", Q._SQL_ENS + """
SELECT arg_id, key_point_id, round(score, 6) AS score, n_folds, prediction FROM ens""")
def q_ensemble_resumed(spark, sf):
    """M4 + J9 as a run taken up again: three folds are scored and committed, then the run is started
    again for all seven, scores the four that are missing, and the ensemble reads all."""
    t = C.tables(spark, sf)
    scored = Q._fold_scored(t).select("arg_id", "key_point_id", "fold", "score", "prediction")
    run_dir = IO.scratch_path(spark, "fold-run")
    one = lambda f: scored.filter(F.col("fold") == f).drop("fold")
    EV.run_folds(spark, run_dir, 3, one)
    return C.normalised(EN.ensemble_scores(EV.run_folds(spark, run_dir, 7, one)))


@register("report_published", Q._REPORT_SQL.replace("\nSELECT m.subset AS name", ",\nrep AS (SELECT m.subset AS name")
          + ")\nSELECT name, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in Q._REPORT_VALUES) + " FROM rep")
def q_report_published(spark, sf):
    """S7 with its swap: a report published, then upserted with a new 'test' row; readers follow the
    pointer to the new version."""
    t = C.tables(spark, sf)
    lab = Q._labelled(t)
    root = IO.scratch_path(spark, "published")
    IO.publish_report(metrics.binary_metrics(lab, group_cols=["subset"]).withColumnRenamed("subset", "name"), root)
    new = with_scalars(metrics.binary_metrics(lab.filter(F.col("subset") == "test")),
                       metrics.mean_average_precision(Q._matched(t))).select(F.lit("test").alias("name"), "*")
    IO.upsert_published(new, root)
    return C.normalised(IO.read_published(spark, root).select("name", *Q._REPORT_VALUES))


_SQL_HALF = """
p AS (SELECT l.arg_id, a.tid, a.argument, l.key_point_id, k.key_point, a.topic, a.stance, l.label
      FROM lab l JOIN a ON l.arg_id = a.arg_id JOIN k ON l.key_point_id = k.key_point_id),
r AS (SELECT arg_id, row_number() OVER (ORDER BY md5(concat('42|', arg_id)), arg_id) AS rn, count(*) OVER () AS n
      FROM (SELECT DISTINCT arg_id FROM p WHERE tid <= 5))
SELECT 'train' AS subset, p.arg_id, argument, key_point_id, key_point, topic, stance, label FROM p JOIN r ON p.arg_id = r.arg_id
WHERE rn <= floor(n * 0.5)
UNION ALL SELECT 'eval', arg_id, argument, key_point_id, key_point, topic, stance, label FROM p WHERE tid IN (6, 7)
UNION ALL SELECT 'test_eval', arg_id, argument, key_point_id, key_point, topic, stance, label FROM p WHERE tid >= 8
UNION ALL SELECT 'test', a.arg_id, a.argument, k.key_point_id, k.key_point, a.topic, a.stance, l.label
FROM a LEFT JOIN k ON a.tid = k.tid AND a.stance = k.stance LEFT JOIN lab l ON l.arg_id = a.arg_id AND l.key_point_id = k.key_point_id
WHERE a.tid >= 8"""


@register("pairs_by_subset", _SQL_HALF)
def q_pairs_by_subset(spark, sf):
    """The one-call loader: half of the train arguments, dev by its other name, the labelled test
    pairs and the test candidates, each from its task files."""
    t = C.tables(spark, sf)
    root = IO.scratch_path(spark, "subset-csv")
    for sub in ("train", "dev", "test"):
        x = t.subset(sub)
        IO.write_task_tables(x.arguments.drop("subset"), x.key_points.drop("subset"), x.labels.drop("subset"),
                             IO.subset_dir(root, sub), sub)
    out = None
    for name, ratio in (("train", 0.5), ("eval", 1.0), ("test_eval", 0.5), ("test", 0.5)):
        part = EV.load_pairs(spark, root, name, ratio).select(F.lit(name).alias("subset"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_CLEAN = "regexp_replace(lower({c}), '[^a-zA-Z]', ' ', 'g')"


@register("pair_segments", f"""
p AS (SELECT l.arg_id, l.key_point_id, a.topic, a.stance FROM lab l JOIN a ON l.arg_id = a.arg_id JOIN k ON l.key_point_id = k.key_point_id)
SELECT arg_id, key_point_id, CAST(2 AS INTEGER) AS n_segments,
       {_CLEAN.format(c='topic')} || CASE WHEN stance = 1 THEN ' is positive' ELSE ' is negative' END || '|' || {_CLEAN.format(c='arg_id')} AS segments
FROM p""")
def q_pair_segments(spark, sf):
    """The extra segments named by a comma list: topic with its stance phrase, and one more column."""
    t = C.tables(spark, sf)
    x = pairs.pair_segments(pairs.labelled_pairs(t.arguments, t.key_points, t.labels), "topic, stance, arg_id")
    return x.select("arg_id", "key_point_id", F.size("segments").alias("n_segments"), F.array_join("segments", "|").alias("segments"))


PIECES = 500      # words of the registered piece vocabulary, besides the letters
_SQL_PIECES = f"""
cw AS (SELECT unnest({SQL_WORDS.format(c='x')}) AS token FROM (SELECT argument AS x FROM a WHERE tid <= 5 UNION ALL SELECT key_point FROM k)),
vr AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS r FROM cw GROUP BY token),
kept AS (SELECT token, r - 1 + {ENC.FIRST_WORD_ID} AS id FROM vr WHERE r <= {PIECES}),
pcs AS MATERIALIZED (SELECT token, id FROM kept UNION ALL
  SELECT c, i - 1 + {ENC.FIRST_WORD_ID + PIECES} FROM (SELECT unnest(string_split('{" ".join(SW.LETTERS)}', ' ')) AS c, unnest(range(1, 27)) AS i)
  WHERE c NOT IN (SELECT token FROM kept)),
ml AS (SELECT max(len(token)) AS m FROM pcs),
src AS (SELECT arg_id, argument, {SQL_WORDS.format(c='argument')} AS w FROM a WHERE tid >= 6),
dw AS MATERIALIZED (SELECT DISTINCT unnest(w) AS word FROM src),
walk AS (
  SELECT word, 1 AS pl, CAST([] AS BIGINT[]) AS ids FROM dw
  UNION ALL
  SELECT word, pl + n, list_append(ids, id) FROM (
    SELECT word, pl, ids, max(n) AS n, arg_max(id, n) AS id FROM (
      SELECT c.word, c.pl, c.ids, c.n, p.id FROM (
        SELECT word, pl, ids, unnest(range(1, least(ml.m, len(word) - pl + 1) + 1)) AS n FROM walk, ml WHERE pl <= len(word)) c
      JOIN pcs p ON p.token = substr(c.word, c.pl, c.n)) GROUP BY word, pl, ids)),
cut AS MATERIALIZED (SELECT word, ids FROM walk WHERE pl = len(word) + 1),
ex AS (SELECT arg_id, argument, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM src)"""


def _pieces(spark, sf):
    t = C.tables(spark, sf)
    corpus = t.arguments.filter(F.col("subset") == "train").select(F.col("argument").alias("x")).unionByName(
        t.key_points.select(F.col("key_point").alias("x")))
    vocab = ENC.vocabulary(corpus, "x", PIECES)
    return t.arguments.filter(F.col("subset") != "train"), materialize(SW.pieces_of_words(vocab, PIECES), "pieces")


@register("encode_subwords")
def q_encode_subwords(spark, sf):
    """E4 by pieces: the first 64 piece ids of every dev and test argument, cut greedily against the
    500 most frequent words of train arguments and key points, and the letters."""
    texts, pieces = _pieces(spark, sf)
    return SW.encode_subwords(texts, "arg_id", "argument", pieces, 64).select("arg_id", F.array_join("ids", " ").alias("ids"))


ORACLE["encode_subwords"] = C.sql(_SQL_PIECES + """,
e AS (SELECT arg_id, pos, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM ex JOIN cut USING (word)),
f AS (SELECT arg_id, id, row_number() OVER (PARTITION BY arg_id ORDER BY pos, i) AS r FROM e)
SELECT src.arg_id, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY r) FILTER (r <= 64), '') AS ids
FROM src LEFT JOIN f USING (arg_id) GROUP BY src.arg_id""").replace("WITH ", "WITH RECURSIVE ", 1)


@register("subword_lengths")
def q_subword_lengths(spark, sf):
    """A15 with pieces: how many pieces the distinct dev and test arguments have."""
    texts, pieces = _pieces(spark, sf)
    distinct = texts.select(F.sha2("argument", 256).alias("d"), "argument").dropDuplicates(["d"])
    n = SW.subword_lengths(distinct, "d", "argument", pieces)
    return C.normalised(n.agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
                              F.sum("len").alias("sum_len"), F.avg("len").alias("mean_len")))


ORACLE["subword_lengths"] = C.sql(_SQL_PIECES + """,
d AS (SELECT argument, min(arg_id) AS arg_id FROM src GROUP BY argument),
n AS (SELECT d.arg_id, coalesce(sum(len(cut.ids)), 0)::BIGINT AS len FROM d LEFT JOIN ex USING (arg_id) LEFT JOIN cut USING (word) GROUP BY d.arg_id)
SELECT count(*) AS n, min(len) AS min_len, max(len) AS max_len, sum(len)::BIGINT AS sum_len, round(avg(len), 6) AS mean_len FROM n""").replace(
    "WITH ", "WITH RECURSIVE ", 1)
