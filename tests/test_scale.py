"""Joins on hot keys, mergeable profiles, samples without a sort, and runs that are interrupted."""

import hashlib
from collections import Counter

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from pairmatch.operators import encode as ENC
from pairmatch.operators import model as MD
from pairmatch.operators import pairs, skew
from pairmatch.operators import profile as PR
from pairmatch.operators import subwords as SW
from pairmatch.operators.metrics import binary_metrics
from pairmatch.plans import evaluate as EV
from pairmatch.sources import io as IO


@pytest.fixture
def no_broadcast(spark):
    """Both sides above the broadcast limit, and no help from AQE's skew join."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_by_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_spread_join_balances_a_hot_word(spark, no_broadcast):
    """One word in a third of all rows, and nulls in a tenth: same rows, no task above 3x the median."""
    n = 30_000
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None))
                                 .otherwise(F.concat(F.lit("w"), (F.col("id") % 4001).cast("string"))).alias("token"), "id")
    right = spark.range(4000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), F.col("id").cast("int").alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1)], "token string, v int"))
    head = right.filter("token = 'hot'")
    got = skew.spread_join(left, right, head, "token", "v")
    plain = left.join(right, "token", "left")
    assert got.columns == ["token", "id", "v"]
    assert got.exceptAll(plain.select(*got.columns)).isEmpty() and got.count() == plain.count() == n
    sizes = rows_by_task(got)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    hot = rows_by_task(plain)
    assert hot[-1] > 3 * hot[len(hot) // 2]            # what the plain join does with it


def test_spread_join_scatters_what_the_head_matched(spark, no_broadcast):
    """The right side as a plain table, not a union: its constant must stay a key of the shuffle."""
    left = spark.range(30_000).select(F.concat(F.lit("w"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 4001).cast("string")).alias("token"), "id")
    right = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), F.col("id").cast("int").alias("v"))
    got = skew.spread_join(left, right, right.filter("v < 4"), "token", "v")
    assert got.filter("token <> concat('w', v)").isEmpty() and got.filter("v IS NULL").isEmpty() and got.count() == 30_000
    sizes = rows_by_task(got)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_grid_join(spark, no_broadcast, how):
    left = spark.range(600).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None))
                                   .otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"))
    right = spark.range(300).select(F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, "hot")
                                    .otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"))
    got = skew.grid_join(left, right, ["k"], how, cell=40)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_grid_join_spreads_a_hot_side(spark, no_broadcast):
    hot = F.when(F.col("id") >= 0, F.lit("hot")).otherwise(F.lit("none"))
    left = spark.range(3000).select(F.col("id").alias("a"), hot.alias("k"))
    right = spark.range(200).select(F.col("id").alias("b"), hot.alias("k"))
    assert len(rows_by_task(left.join(right, "k"))) == 1
    got = skew.grid_join(left, right, ["k"], cell=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_r" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    sizes = rows_by_task(got)
    assert sum(sizes) == 600_000 and len(sizes) == 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_grid_lists_hot_keys_only(spark):
    left = spark.createDataFrame([("h",)] * 90 + [("c",)] * 10, "k string")
    right = spark.createDataFrame([("h",)] * 25 + [("c",)] * 3, "k string")
    assert [tuple(r) for r in skew.grid_of(left, right, ["k"], 20).collect()] == [("h", 5, 2)]
    with pytest.raises(ValueError):
        skew.grid_join(left, right, ["k"], "full")


def test_candidates_by_grid(spark, no_broadcast):
    a = spark.createDataFrame([(f"arg_{i % 3}_{i}", f"t{i % 3}", 1 if i % 2 else -1) for i in range(90)], "arg_id string, topic string, stance int")
    k = spark.createDataFrame([(f"kp_{i % 2}_{i}", f"t{i % 2}", 1 if i % 3 else -1) for i in range(40)], "key_point_id string, topic string, stance int")
    plain, grid = pairs.candidate_ids(a, k), pairs.candidate_ids(a, k, cell=7)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, grid.collect()))
    assert plain.filter("key_point_id IS NULL").count() == 30


def test_encode_with_a_word_in_every_text(spark, no_broadcast):
    texts = spark.createDataFrame([(str(i), "the " * 5 + f"w{chr(97 + i % 26)} zzz") for i in range(50)] + [("e", ""), ("n", None)], "k string, x string")
    vocab = ENC.vocabulary(texts.filter("k <> '0'"), "x")
    ids = {r.k: r.ids for r in ENC.token_ids(texts, "k", "x", vocab, 6).collect()}
    the = vocab.filter("token = 'the'").first().token_id
    assert the == ENC.FIRST_WORD_ID and ids["3"][:5] == [the] * 5 and ids["e"] == ids["n"] == []


# ---------------------------------------------------------------- sample

@pytest.mark.parametrize("k", [0, 1, 37, 400, 999, 1000, 5000])
def test_smallest(spark, k):
    ids = [f"arg_{i}" for i in range(1000)]
    df = spark.createDataFrame([(i, hashlib.md5(i.encode()).hexdigest()) for i in ids], "id string, h string").repartition(6)
    want = sorted(ids, key=lambda i: (hashlib.md5(i.encode()).hexdigest(), i))[:k]
    assert sorted(r.id for r in pairs.smallest(df, "h", "id", k).collect()) == sorted(want)


def test_smallest_without_digests(spark):
    df = spark.createDataFrame([("a", "0f"), ("b", None), ("c", "01")], "id string, h string")
    assert [r.id for r in pairs.smallest(df, "h", "id", 1).collect()] == ["c"] and pairs.smallest(df, "h", "id", 9).count() == 2
    p = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "arg_id string, x int")
    assert {r.arg_id for r in pairs.sample_arguments(p, 0.5).collect()} < {"a", "b"}


def test_smallest_plans_no_range_sort(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.md5(F.col("id").cast("string")).alias("h"))
    plan = pairs.smallest(df, "h", "id", 300)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_smallest_with_equal_digests(spark):
    df = spark.createDataFrame([(str(i), "00ff") for i in range(9)], "id string, h string")
    assert sorted(r.id for r in pairs.smallest(df, "h", "id", 4).collect()) == list("0123")


# ---------------------------------------------------------------- profile

def test_sketches_of_parts_make_the_sketch_of_the_whole(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 9973).alias("v"), F.lit(None).cast("string").alias("none"))
    parts = PR.sketch_profile(df, ["v", "none"], ["g"])
    whole = PR.profile_estimates(PR.merge_profiles(parts)).first()
    direct = PR.profile_estimates(PR.sketch_profile(df, ["v", "none"])).first()
    assert (whole.n_rows, whole.nonnull_v, whole.nonnull_none, whole.distinct_none) == (20_000, 20_000, 0, 0)
    # a union's estimator differs from a single sketch's: both within the bound
    for r in (whole, direct):
        assert abs(r.distinct_v - 9973) <= PR.error_bound() * 9973
    added = PR.merge_profiles(parts.unionByName(PR.sketch_profile(df.filter("g = 0"), ["v", "none"], ["g"])))
    assert PR.profile_estimates(added).first().distinct_v == whole.distinct_v       # seen rows add nothing


def test_frame_info(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", None)], "a int, `b.c` string, d string")
    assert [tuple(r) for r in PR.frame_info(df).collect()] == [(0, "a", 2, "int"), (1, "b.c", 1, "string"), (2, "d", 1, "string")]


# ---------------------------------------------------------------- pieces

def test_subwords(spark):
    pieces = spark.createDataFrame([("un", 10), ("unable", 11), ("a", 12), ("ble", 13), ("b", 14), ("l", 15)], "token string, token_id int")
    cut = {r.word: r.ids for r in SW.cut_words(spark.createDataFrame([(w,) for w in ("unable", "unab", "ablel", "xa", "a", "unx")], "word string"), pieces).collect()}
    assert cut == {"unable": [11], "unab": [10, 12, 14], "ablel": [12, 13, 15], "xa": [1], "a": [12], "unx": [1]}
    texts = spark.createDataFrame([("1", "Unable, a xa"), ("2", ""), ("3", None), ("4", "ablel ablel")], "k string, x string")
    got = {r.k: r.ids for r in SW.encode_subwords(texts, "k", "x", pieces, 4).collect()}
    assert got == {"1": [11, 12, 1], "2": [], "3": [], "4": [12, 13, 15, 12]}
    assert {r.k: r.len for r in SW.subword_lengths(texts, "k", "x", pieces).collect()} == {"1": 3, "2": 0, "3": 0, "4": 6}


def test_pieces_of_words(spark):
    vocab = ENC.vocabulary(spark.createDataFrame([("b the the b b zz",)], "x string"), "x")
    got = {r.token: r.token_id for r in SW.pieces_of_words(vocab, 2).collect()}
    assert got["b"] == 4 and got["the"] == 5 and "zz" not in got and len(got) == 27 and got["a"] == 6 and got["z"] == 31


# ---------------------------------------------------------------- interrupted runs

def test_fold_run_is_taken_up_again(spark, tmp_path):
    planned = []

    def scores(stop):
        def one(f):
            planned.append(f)
            if f == stop:
                raise RuntimeError("killed")
            return spark.createDataFrame([("a", "k", float(f), f % 2)], "arg_id string, key_point_id string, score double, prediction int")
        return one

    run = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        EV.run_folds(spark, run, 5, scores(3))
    spark.createDataFrame([("a", "k", 99.0, 1)], "arg_id string, key_point_id string, score double, prediction int").write.parquet(f"{run}/fold=3")
    (tmp_path / "run" / "fold=3" / "_SUCCESS").unlink()          # half-written when the run died
    (tmp_path / "run" / "fold=3" / "._SUCCESS.crc").unlink()
    planned.clear()
    out = EV.run_folds(spark, run, 5, scores(None))
    assert planned == [3, 4]
    assert sorted((r.fold, r.score) for r in out.collect()) == [(f, float(f)) for f in range(5)]
    planned.clear()
    assert EV.run_folds(spark, run, 5, scores(None)).count() == 5 and planned == []


def test_a_crash_before_the_swap_leaves_the_old_report(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "report")
    schema = "name string, mode string, f1 double"
    assert IO.read_published(spark, root) is None
    IO.publish_report(spark.createDataFrame([("r1", "plain", 0.5)], schema), root)
    first = IO.current_version(spark, root)

    def crash(*a):
        raise RuntimeError("died between write and swap")

    with monkeypatch.context() as m:
        m.setattr(IO, "_point_to", crash)
        with pytest.raises(RuntimeError):
            IO.upsert_published(spark.createDataFrame([("r1", "plain", 0.9)], schema), root)
    assert IO.current_version(spark, root) == first and [r.f1 for r in IO.read_published(spark, root).collect()] == [0.5]
    IO.upsert_published(spark.createDataFrame([("r2", "plain", 0.25)], schema), root)
    assert {r.name: r.f1 for r in IO.read_published(spark, root).collect()} == {"r1": 0.5, "r2": 0.25}
    assert [r.f1 for r in IO.read_report(spark, first).collect()] == [0.5]         # readers of the old version go on


def test_load_pairs(spark, tmp_path):
    root = str(tmp_path)
    for sub, topic in (("train", 1), ("dev", 2), ("test", 3)):
        a = spark.createDataFrame([(f"arg_{topic}_{i}", f"text {i}", f"t{topic}", 1) for i in range(6)], "arg_id string, argument string, topic string, stance int")
        k = spark.createDataFrame([(f"kp_{topic}_{i}", f"point {i}", f"t{topic}", 1) for i in range(2)], "key_point_id string, key_point string, topic string, stance int")
        lab = spark.createDataFrame([(f"arg_{topic}_{i}", f"kp_{topic}_0", i % 2) for i in range(6)], "arg_id string, key_point_id string, label int")
        IO.write_task_tables(a, k, lab, IO.subset_dir(root, sub), sub)
    assert EV.load_pairs(spark, root, "train", 0.5).select("arg_id").distinct().count() == 3
    assert EV.load_pairs(spark, root, "dev").count() == EV.load_pairs(spark, root, "eval").count() == 6
    assert EV.load_pairs(spark, root, "test_eval", 0.5).count() == 6               # scoring subsets are not sampled
    test = EV.load_pairs(spark, root, "test", 0.5)
    assert test.count() == 12 and test.filter("label IS NULL").count() == 6


def test_kfold_run_has_both_parts(spark):
    rows = [(f, f"arg_1_{i}", f"kp_1_{i % 2}", i % 2, (i + f) % 5 / 5.0, i % 2) for f in range(2) for i in range(8)]
    scored = spark.createDataFrame(rows, "fold int, arg_id string, key_point_id string, golden_label int, score double, prediction int")
    a = spark.createDataFrame([(f"arg_1_{i}", "x", "t", 1) for i in range(8)], "arg_id string, argument string, topic string, stance int")
    k = spark.createDataFrame([("kp_1_0", "p", "t", 1), ("kp_1_1", "q", "t", 1)], "key_point_id string, key_point string, topic string, stance int")
    lab = spark.createDataFrame([(f"arg_1_{i}", f"kp_1_{i % 2}", i % 2) for i in range(8)], "arg_id string, key_point_id string, label int")
    dev = scored.withColumnRenamed("golden_label", "label")
    report, ens = EV.kfold_run("r", scored, a, k, lab, 2, dev_scored=dev)
    r = report.first().asDict()
    assert r["name"] == "r_kfold" and r["acc"] == r["acc_test"] == 1.0 and {"f1", "f1_test", "auc", "auc_test", "mAP_strict"} <= set(r)
    assert r["auc"] == pytest.approx(sum(x.auc for x in binary_metrics(dev, group_cols=["fold"]).collect()) / 2)
    assert {x.arg_id: x.golden_label for x in ens.collect()} == {f"arg_1_{i}": i % 2 for i in range(8)}


def test_scratch_is_dropped_at_the_end_of_a_job(spark, tmp_path, monkeypatch):
    from pairmatch import session
    from pairmatch.operators.sizing import materialize
    monkeypatch.setattr(session, "_SCRATCH", [])          # the folders of other tests stay
    df = materialize(spark.range(5), "kept")
    path = session._SCRATCH[0]
    table = session.scratch_path(spark, "bucketed")
    spark.range(3).write.option("path", table).saveAsTable(session.scratch_table(table))
    assert df.count() == 5 and IO.path_exists(spark, path)
    assert session.drop_scratch(spark) == 2 and session._SCRATCH == []
    assert not IO.path_exists(spark, path) and not IO.path_exists(spark, table)
    assert not spark.catalog.tableExists(session.scratch_table(table))
    assert session.drop_scratch(spark) == 0


# ---------------------------------------------------------------- joins by topic

def test_segments_gather_no_topic(spark, no_broadcast):
    a = spark.createDataFrame([(f"arg_1_{i}", f"text {i}", "topic 1", 1 if i % 2 else -1) for i in range(400)] + [("arg_x", "t", None, 1)],
                              "arg_id string, argument string, topic string, stance int")
    k = spark.createDataFrame([(f"kp_1_{i}", f"point {i}") for i in range(40)], "key_point_id string, key_point string")
    keys = a.select("arg_id").join(k.select("key_point_id"))
    got = pairs.pair_text_topic_stance(keys, a, k)
    rows = {(r.arg_id, r.key_point_id): (r.argument_clean, r.key_point_clean, r.topic_segment) for r in got.collect()}
    assert len(rows) == got.count() == 16_000
    assert rows["arg_1_3", "kp_1_0"] == ("text  ", "point  ", "topic   is positive")
    assert rows["arg_1_4", "kp_1_0"][2] == "topic   is negative"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(topic" not in plan and "hashpartitioning(stance" not in plan


# ---------------------------------------------------------------- rows of a fit

def test_a_fit_grows_by_tasks(spark, monkeypatch):
    """Four times the pairs of the same texts: four times the partitions, none with more rows."""
    a = spark.createDataFrame([(f"arg_1_{i}", "one two three " * (i % 7 + 1)) for i in range(40)], "arg_id string, argument string")
    k = spark.createDataFrame([(f"kp_1_{i}", f"two {chr(97 + i % 26)}") for i in range(200)], "key_point_id string, key_point string")
    monkeypatch.setattr(MD, "FIT_BYTES", 30_000)
    most = MD.fit_rows(a, k, 64)
    seen = []
    monkeypatch.setattr(MD, "LogisticRegression", lambda **kw: seen.append(kw) or LogisticRegression(**kw))
    sizes = []
    monkeypatch.setattr(MD.Pipeline, "fit", lambda self, data: sizes.append(rows_by_task(data)))
    for n in (50, 200):
        p = a.select("arg_id").join(k.limit(n).select("key_point_id")).withColumn("label", F.length("key_point_id") % 2)
        MD.fit(p, arguments=a, key_points=k, num_features=64)
    assert sum(sizes[0]) == 2000 and sum(sizes[1]) == 8000 and len(seen) == 2
    assert max(sizes[0] + sizes[1]) <= most and len(sizes[1]) > 2 * len(sizes[0])
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != spark.conf.get("spark.sql.files.openCostInBytes")
