"""Newton fits as aggregates against Newton steps in numpy, and against Spark ML's optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.operators import newton as NW

X = ("x1", "x2")


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + 1.2 * x[:, 0] - 0.8 * x[:, 1])))).astype(int)
    rows = [(int(i), float(a), float(b), int(c), int(i % 3)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return rows, spark.createDataFrame(rows, "id int, x1 double, x2 double, label int, fold int").repartition(5)


def newton(rows, pos_weight=1.0, steps=NW.STEPS, reg=NW.REG):
    x = np.array([[1.0, r[1], r[2]] for r in rows])
    y = np.array([r[3] for r in rows], dtype=float)
    c = np.where(y == 1, pos_weight, 1.0)
    w = np.zeros(3)
    ridge = reg * c.sum() * np.array([0.0, 1.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w + np.linalg.solve(h, x.T @ (c * (y - p)) - ridge * w)
    return w


def test_fit(spark):
    rows, df = table(spark)
    assert np.allclose(NW.fit(df, X, pos_weight=2.0), newton(rows, 2.0), atol=1e-9)


def test_fit_reaches_the_optimum(spark):
    """The gradient of Spark ML's objective vanishes at the weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    _, df = table(spark, 300, seed=3)
    v = VectorAssembler(inputCols=list(X), outputCol="f").transform(df).withColumn("y", F.col("label").cast("double"))
    m = LogisticRegression(featuresCol="f", labelCol="y", regParam=NW.REG, standardization=False, tol=1e-10, maxIter=200).fit(v)
    assert np.allclose(NW.fit(df, X), [m.intercept, *m.coefficients], atol=1e-5)


def test_folds_in_one_pass(spark):
    rows, df = table(spark)
    got = NW.fit_folds(df, 3, X)
    for f in range(3):
        assert np.allclose(got[f], newton([r for r in rows if r[4] != f]), atol=1e-9)
    scored = NW.score_folds(df.select("id", *X), got, X, keep=("id",)).filter("id = 7").orderBy("fold").collect()
    want = [w[0] + w[1] * rows[7][1] + w[2] * rows[7][2] for w in got]
    assert [r.fold for r in scored] == [0, 1, 2] and np.allclose([r.logit for r in scored], want)
    assert [r.prediction for r in scored] == [int(v > 0) for v in want]


def test_edge_cases(spark):
    schema = "x1 double, x2 double, label int"
    assert NW.fit(spark.createDataFrame([], schema), X) == [0.0, 0.0, 0.0]
    rows = [(1.0, None, 1), (2.0, None, 0), (0.5, 0.0, 1), (3.0, 0.0, 0), (9.0, 9.0, None)]
    w = NW.fit(spark.createDataFrame(rows, schema), X)       # a constant feature, a row without a label
    assert np.isfinite(w).all() and w[1] < 0 and w[2] == pytest.approx(0)
    one_class = NW.fit(spark.createDataFrame([(1.0, 2.0, 1), (2.0, 1.0, 1)], schema), X)
    assert np.isfinite(one_class).all() and one_class[0] > 2


def test_a_step_returns_sums_only(spark):
    """One row per model reaches the driver: its weight, gradient and upper triangle."""
    _, df = table(spark)
    rows = NW._sums(df.select("fold", F.col("label").cast("double").alias("y"), F.lit(1.0).alias("c"), *X), np.zeros((3, 3)))
    assert len(rows) == 3
    assert set(rows[0].asDict()) == {"model", "c", "g0", "g1", "g2", *[f"h{i}_{j}" for i in range(3) for j in range(i, 3)]}


def test_overlap_features(spark):
    a = spark.createDataFrame([("a1", "The cat, the DOG"), ("a2", None)], "arg_id string, argument string")
    k = spark.createDataFrame([("k1", "dog and cat!"), ("k2", "")], "key_point_id string, key_point string")
    p = spark.createDataFrame([(x, y, 1) for x in ("a1", "a2") for y in ("k1", "k2")], "arg_id string, key_point_id string, label int")
    got = {(r.arg_id, r.key_point_id): (r.n_shared, round(r.jaccard, 6), round(r.log_len_a, 6), round(r.log_len_b, 6), r.label)
           for r in NW.overlap_features(p, a, k).collect()}
    ln = lambda n: round(float(np.log1p(n)), 6)
    assert got == {("a1", "k1"): (2.0, 0.5, ln(3), ln(3), 1), ("a1", "k2"): (0.0, 0.0, ln(3), 0.0, 1),
                   ("a2", "k1"): (0.0, 0.0, 0.0, ln(3), 1), ("a2", "k2"): (0.0, 0.0, 0.0, 0.0, 1)}


def test_hashed_features_have_the_overlap(spark):
    from pairmatch.operators import model as MD
    a = spark.createDataFrame([("a1", "The cat, the DOG")], "arg_id string, argument string")
    k = spark.createDataFrame([("k1", "dog and cat!")], "key_point_id string, key_point string")
    p = spark.createDataFrame([("a1", "k1")], "arg_id string, key_point_id string")
    v = MD.hashed_features(p, a, k, 64).first().features
    assert v.size == 3 * 64 + 4 and list(v.toArray()[-4:-2]) == [2.0, 0.5]
    assert [v.toArray()[i * 64:(i + 1) * 64].sum() for i in range(3)] == [3, 3, 2]
