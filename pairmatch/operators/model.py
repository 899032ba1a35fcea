"""Pair classifier re-aimed at Spark ML (M1-M4).

The reference fine-tunes a transformer on one GPU. Here the matching model is a
``pyspark.ml`` pipeline trained where the data lives: hashed words of the cleaned argument and
key point, their shared words, and overlap numbers, into a class-weighted logistic regression
(M2: ``weightCol``). Scoring is ``model.transform`` (Arrow-free, JVM side); any outside scorer
plugs in through ``operators.scoring.score_with`` instead.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .sizing import file_per_task, materialize, spread_pairs
from .skew import HEAD, spread_join

NUM_FEATURES = 1 << 16
SIDE_FEATURES = 1 << 13    # per kind of word (argument, key point, shared) in ``hashed_features``
FIT_BYTES = 128 << 20      # features that a task of a fit holds in memory, about


def fit_rows(arguments: DataFrame, key_points: DataFrame, num_features: int) -> int:
    """Rows of about ``FIT_BYTES`` of features. A fit keeps its rows unpacked in memory, one partition
    per file, and they repeat an argument's words for each of its pairs, which compresses well: neither
    files nor the session's partitions tell their size. A vector takes about as many bytes as its text."""
    def size(texts: DataFrame, text: str) -> float:
        return texts.agg(F.avg(F.least(F.length(text), F.lit(12 * num_features)))).first()[0] or 0.0
    row = size(arguments, "argument") + 2 * size(key_points, "key_point") + 100
    return max(1, int(FIT_BYTES / row))


def _features(x: DataFrame) -> DataFrame:
    """Features from the distinct-word arrays ``_wa`` (argument) and ``_wb`` (key point)."""
    shared = F.array_intersect("_wa", "_wb")
    union = F.array_union("_wa", "_wb")
    toks = F.concat(F.transform("_wa", lambda w: F.concat(F.lit("a:"), w)),
                    F.transform("_wb", lambda w: F.concat(F.lit("b:"), w)),
                    F.transform(shared, lambda w: F.concat(F.lit("s:"), w)))
    return (x.withColumn("tokens", toks)
            .withColumn("n_shared", F.size(shared).cast("double"))
            .withColumn("jaccard", F.coalesce(F.try_divide(F.size(shared).cast("double"),
                                                           F.size(union).cast("double")), F.lit(0.0)))
            .withColumn("log_len_a", F.log1p(F.size("_wa").cast("double")))
            .withColumn("log_len_b", F.log1p(F.size("_wb").cast("double")))
            .drop("_wa", "_wb"))


def pair_features(pairs: DataFrame, arguments: DataFrame | None = None,
                  key_points: DataFrame | None = None) -> DataFrame:
    """Token features of a pair: 'a:' words of the argument, 'b:' words of the key point, 's:'
    words they share, and numeric overlap (shared count, Jaccard, log lengths).

    With ``arguments`` (arg_id, argument) and ``key_points`` (key_point_id, key_point) the
    pairs need only ids: each text is tokenised once and its word set joined by key (the key
    points), instead of once per candidate pair."""
    if arguments is None or key_points is None:
        x = (pairs.withColumn("_wa", F.array_distinct(words("argument")))
             .withColumn("_wb", F.array_distinct(words("key_point"))))
        return _features(x)
    aw = arguments.select("arg_id", F.array_distinct(words("argument")).alias("_wa"))
    kw = key_points.select("key_point_id", F.array_distinct(words("key_point")).alias("_wb"))
    x = pairs.join(aw, "arg_id").join(kw, "key_point_id")
    return _features(x)


def class_weight(label: str = "label", pos_weight: float = 1.0):
    """M2: weight pos_weight for positives, 1 for negatives."""
    return F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0))


def pair_classifier(max_iter: int = 30, reg: float = 0.01, num_features: int = NUM_FEATURES) -> Pipeline:
    """``num_features`` is the width of the hashed words: raise it as the vocabulary grows."""
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    va = VectorAssembler(inputCols=["tf", "n_shared", "jaccard", "log_len_a", "log_len_b"],
                         outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[tf, va, lr])


def fit_features(features: DataFrame, pos_weight: float = 1.0, **kw) -> PipelineModel:
    """M1 + M2 on precomputed ``pair_features`` rows with a label."""
    data = (features.filter(F.col("label").isNotNull())
            .withColumn("weight", class_weight("label", pos_weight))
            .withColumn("label", F.col("label").cast("double")))
    with file_per_task(data.sparkSession):
        return pair_classifier(**kw).fit(data)


def score_features(model: PipelineModel, features: DataFrame,
                   keep=("arg_id", "key_point_id")) -> DataFrame:
    """M3 on precomputed features: logits (l0 = 0, l1 = margin, so the C9 softmax gives the
    model probability), score = P(label 1), prediction = argmax."""
    out = model.transform(features)
    raw = vector_to_array("rawPrediction")
    prob = vector_to_array("probability")
    return out.select(*keep, F.lit(0.0).alias("l0"), raw[1].alias("l1"),
                      prob[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))


def hashed_features(pairs: DataFrame, arguments: DataFrame, key_points: DataFrame,
                    num_features: int = SIDE_FEATURES) -> DataFrame:
    """The features of ``pair_features`` as vectors: an argument's and a key point's words are hashed
    once per text (``va``, ``vb``), a pair hashes only the words they share (``vs``). A pair row
    carries the finished vectors, no text. Each iteration of a fit moves one vector of the model's
    width per task, so the width is what an iteration costs while the pairs are few: raise it with the
    vocabulary."""
    def side(texts: DataFrame, key: str, text: str, out: str, vector: str) -> DataFrame:
        t = texts.select(key, F.array_distinct(words(text)).alias(out))
        return HashingTF(inputCol=out, outputCol=vector, numFeatures=num_features).transform(t)

    x = (spread_pairs(pairs).join(side(arguments, "arg_id", "argument", "_wa", "va"), "arg_id")
         .join(side(key_points, "key_point_id", "key_point", "_wb", "vb"), "key_point_id"))
    na, nb = F.size("_wa").cast("double"), F.size("_wb").cast("double")
    x = x.select(*pairs.columns, "va", "vb", na.alias("_na"), nb.alias("_nb"), F.array_intersect("_wb", "_wa").alias("_s"))
    x = HashingTF(inputCol="_s", outputCol="vs", numFeatures=num_features).transform(x)
    n = F.size("_s").cast("double")
    x = x.select(*pairs.columns, "va", "vb", "vs", n.alias("n_shared"),
                 F.coalesce(F.try_divide(n, F.col("_na") + F.col("_nb") - n), F.lit(0.0)).alias("jaccard"),
                 F.log1p("_na").alias("log_len_a"), F.log1p("_nb").alias("log_len_b"))
    return VectorAssembler(inputCols=["va", "vb", "vs", "n_shared", "jaccard", "log_len_a", "log_len_b"],
                           outputCol="features").transform(x).select(*pairs.columns, "features")


def fit(train_pairs: DataFrame, pos_weight: float = 1.0, arguments: DataFrame | None = None,
        key_points: DataFrame | None = None, max_iter: int = 30, reg: float = 0.01,
        num_features: int = SIDE_FEATURES) -> PipelineModel:
    """M1: fit on labelled pairs (arg_id, key_point_id, label, and the two texts unless the
    text tables are given). With text tables the features are hashed before the join and written
    once, so the iterations read finished vectors, in files of bounded rows: more pairs make more
    tasks, not larger ones."""
    labelled = train_pairs.filter(F.col("label").isNotNull())
    if arguments is None or key_points is None:
        return fit_features(pair_features(labelled), pos_weight, max_iter=max_iter, reg=reg, num_features=num_features)
    data = materialize(hashed_features(labelled.select("arg_id", "key_point_id", F.col("label").cast("double").alias("label")),
                                       arguments, key_points, num_features), "pair-vectors", fit_rows(arguments, key_points, num_features))
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, regParam=reg)
    with file_per_task(data.sparkSession):
        return Pipeline(stages=[lr]).fit(data.withColumn("weight", class_weight("label", pos_weight)))


def score(model: PipelineModel, pairs: DataFrame, keep=("arg_id", "key_point_id"),
          arguments: DataFrame | None = None, key_points: DataFrame | None = None,
          num_features: int = SIDE_FEATURES) -> DataFrame:
    """M3: score candidate pairs (rows without a key point are skipped), with the features that the
    model was fitted on: text tables here if and only if there."""
    real = pairs.filter(F.col("key_point_id").isNotNull())
    if arguments is None or key_points is None:
        return score_features(model, pair_features(real), keep)
    return score_features(model, hashed_features(real.select(*keep), arguments, key_points, num_features), keep)


def kfold_scores(fit_pairs_with_fold: DataFrame, to_score: DataFrame, num_folds: int,
                 pos_weight: float = 1.0, arguments: DataFrame | None = None,
                 key_points: DataFrame | None = None, **kw) -> DataFrame:
    """M4: one model per fold (trained on the other folds), each scoring ``to_score``; the
    result is one long table with a ``fold`` column, ready for ``ensemble_scores``.
    Features of the fit pairs and of the pairs to score are computed once and written to the
    shared checkpoint folder; every fold filters the same feature table (no text is tokenised
    k times, and a lost executor re-reads files instead of recomputing the features)."""
    texts = (fit_pairs_with_fold, fit_pairs_with_fold) if arguments is None or key_points is None else (arguments, key_points)
    fit_feats = materialize(pair_features(
        fit_pairs_with_fold.filter(F.col("label").isNotNull()), arguments, key_points),
        "fold-features", fit_rows(*texts, kw.get("num_features", NUM_FEATURES)))
    score_feats = materialize(pair_features(
        to_score.filter(F.col("key_point_id").isNotNull()), arguments, key_points),
        "score-features")
    parts = []
    for f in range(num_folds):
        m = fit_features(fit_feats.filter(F.col("fold") != f), pos_weight, **kw)
        parts.append(score_features(m, score_feats).withColumn("fold", F.lit(f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- k-fold naive Bayes (M4)

def pair_tokens(pairs: DataFrame, arguments: DataFrame, key_points: DataFrame,
                extra: tuple[str, ...] = ()) -> DataFrame:
    """The pair tokens of ``pair_features`` ('b:' key-point words, 's:' words shared with the
    whole argument), one row per (pair, token); a pair without tokens keeps one row with a
    null token. Each text is tokenised once and joined by key."""
    aw = arguments.select("arg_id", F.array_distinct(words("argument")).alias("_wa"))
    kw = key_points.select("key_point_id", F.array_distinct(words("key_point")).alias("_wb"))
    x = (pairs.select("arg_id", "key_point_id", *extra).join(aw, "arg_id")
         .join(kw, "key_point_id"))
    toks = F.concat(F.transform("_wb", lambda w: F.concat(F.lit("b:"), w)),
                    F.transform(F.array_intersect("_wa", "_wb"), lambda w: F.concat(F.lit("s:"), w)))
    return x.select("arg_id", "key_point_id", *extra, F.explode_outer(toks).alias("token"))


def naive_bayes_kfold(train_tokens: DataFrame, train_rows: DataFrame, score_tokens: DataFrame,
                      num_folds: int, alpha: float = 1.0) -> DataFrame:
    """M4 as one pass: k multinomial naive-Bayes models over binary pair tokens, model f
    trained on every fold but f, each scoring ``score_tokens``.

    ``train_tokens``: (token, label, fold) per training pair token; ``train_rows``: (label,
    fold) per training pair; ``score_tokens``: (arg_id, key_point_id, token).
    Model f: n(t, c) = rows of class c in folds != f containing t, N(c) = sum over t, V = tokens
    seen in folds != f; weight(t) = ln((n(t,1)+a) / (N(1)+aV)) - ln((n(t,0)+a) / (N(0)+aV));
    prior = ln((R(1)+1) / (R(0)+1)) over training rows; logit = prior + sum of weights of the
    pair's known tokens. Leave-one-fold-out counts are totals minus the fold's own counts, so
    no model is fitted k times; every step is a partial aggregate or a key join, and the join of the
    pairs' tokens, where a word may be in every pair, is a ``spread_join``.
    Returns (arg_id, key_point_id, fold, logit, score, prediction)."""
    a = float(alpha)
    y = F.col("label") == 1
    # read by five branches below: counted once, so that the pairs' tokens are made once
    per_fold = materialize(train_tokens.filter(F.col("token").isNotNull()).groupBy("fold", "token").agg(
        F.count(F.when(y, 1)).alias("n1"), F.count(F.when(~y, 1)).alias("n0")), "token-counts")
    tot = per_fold.groupBy("token").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    targets = F.explode(F.sequence(F.lit(0), F.lit(num_folds - 1))).alias("target")
    own = per_fold.select("token", F.col("fold").alias("target"), F.col("n1").alias("f1"),
                          F.col("n0").alias("f0"))
    lo = (tot.select("token", "t1", "t0", targets)
          .join(own, ["token", "target"], "left")
          .select("token", "target",
                  (F.col("t1") - F.coalesce("f1", F.lit(0))).alias("n1"),
                  (F.col("t0") - F.coalesce("f0", F.lit(0))).alias("n0"))
          .filter(F.col("n1") + F.col("n0") > 0))
    stats = lo.groupBy("target").agg(F.sum("n1").alias("_all1"), F.sum("n0").alias("_all0"),
                                     F.count(F.lit(1)).alias("_vocab"))
    weights = lo.join(F.broadcast(stats), "target").select(  # k rows: a proven bound
        "target", "token",
        (F.log((F.col("n1") + a) / (F.col("_all1") + a * F.col("_vocab")))
         - F.log((F.col("n0") + a) / (F.col("_all0") + a * F.col("_vocab")))).alias("w"))
    rows = train_rows.groupBy("fold").agg(F.count(F.when(y, 1)).alias("r1"),
                                          F.count(F.when(~y, 1)).alias("r0"))
    priors = (rows.select("fold", "r1", "r0", targets).filter(F.col("fold") != F.col("target"))
              .groupBy("target").agg(F.log((F.sum("r1") + 1.0) / (F.sum("r0") + 1.0)).alias("prior")))
    # one row per token with its k weights; its frequent tokens meet the pairs by broadcast
    packed = materialize(weights.groupBy("token").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("target") == f, F.col("w"))), F.lit(0.0)) for f in range(num_folds)]).alias("ws")), "token-weights")
    frequent = tot.orderBy((F.col("t1") + F.col("t0")).desc(), "token").limit(HEAD).select("token")
    head = packed.join(F.broadcast(frequent), "token", "left_semi")      # at most HEAD rows
    met = spread_join(score_tokens.select("arg_id", "key_point_id", "token"), packed, head, "token", "ws")
    sums = met.groupBy("arg_id", "key_point_id").agg(*[
        F.sum(F.coalesce(F.col("ws")[f], F.lit(0.0))).alias(f"_s{f}") for f in range(num_folds)])
    logits = F.array(*[F.struct(F.lit(int(r.target)).alias("fold"), (F.lit(float(r.prior)) + F.col(f"_s{r.target}")).alias("logit"))
                       for r in priors.collect()])                     # at most k rows
    logit = F.col("logit")
    return (sums.select("arg_id", "key_point_id", F.inline(logits))
            .select("arg_id", "key_point_id", "fold", "logit", (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("score"),
                    (logit > 0).cast("int").alias("prediction")))
