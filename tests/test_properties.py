"""Property and known-answer tests of the kernels and statistics."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from detecteval.functions.hashing import H, py_hash
from detecteval.operators import curves as cv
from detecteval.operators import grid as gd
from detecteval.operators import sampling as sa
from detecteval.operators import stats as st
from detecteval.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_py_hash_matches_spark(spark):
    r = spark.range(1).select(H(0, "fold", F.lit("src3")).alias("h")).collect()[0]["h"]
    assert r == py_hash(0, "fold", "src3")


def test_bucketed_prefix_equals_plain_window(spark):
    pt = fx.scored_events(spark, SF)
    a = cv.pr_curve(pt, ["model"], n_buckets=16).orderBy("model", "score").collect()
    b = cv.pr_curve(pt, ["model"], n_buckets=1).orderBy("model", "score").collect()
    assert a == b


def test_same_result_under_partitionings(spark):
    pt = fx.scored_events(spark, SF)
    out = []
    for parts in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out.append(sorted(cv.compute_metrics(pt.repartition(int(parts)), ["model"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def test_exact_k_returns_exactly_k(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id") \
        .withColumn("g", (F.col("row_id") % 3).cast("int")) \
        .withColumn("_h", H(7, "s", F.col("row_id")))
    quota = spark.createDataFrame([(0, 10), (1, 1000), (2, 0)], "g int, k long")
    got = sa.take_k_by_hash(df, ["g"], quota, bucket_bits=28)
    counts = dict(got.groupBy("g").count().collect())
    assert counts.get(0) == 10 and counts.get(1) == 1000 and 2 not in counts
    w = Window.partitionBy("g").orderBy("_h", "row_id")
    ref = df.withColumn("r", F.row_number().over(w)).join(quota, "g").filter(F.col("r") <= F.col("k"))
    assert sorted(got.select("row_id").collect()) == sorted(ref.select("row_id").collect())


def test_grid_index_matches_brute_force(spark):
    lo, hi, n = 0.01, 0.99, 1000
    grid = [i * ((hi - lo) / (n - 1)) + lo for i in range(n - 1)] + [hi]
    scores = [i / 1000.0 for i in range(1001)] + list(grid[::7])
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    got = df.select("score", gd.grid_index(F.col("score"), lo, hi, n).alias("i")).collect()
    for r in got:
        want = max([i for i, g in enumerate(grid) if g <= r["score"]], default=-1)
        assert r["i"] == want, r


def test_wilcoxon_known_answer(spark):
    # Six non-zero differences, all negative: W = 0, exact p = 2/64.
    rows = [(i, 0.5, 0.5 + 0.01 * (i + 1)) for i in range(6)] + [(6, 0.3, 0.3)]
    df = spark.createDataFrame(rows, "i int, a double, b double").withColumn("t", F.lit("x"))
    r = st.wilcoxon(df, ["t"], "a", "b").collect()[0]
    assert r["n"] == 6 and r["statistic"] == 0.0 and abs(r["p_value"] - 0.03125) < 1e-12


def test_spearman_monotone(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "m double, gap double")
    r = st.spearman(df, ["m"], "gap").collect()[0]
    assert abs(r["rho"] - 1.0) < 1e-12 and r["p_value"] < 1e-6


def test_t_sf_against_known_values():
    # P(T > 2.0) for df = 5 and df = 10.
    assert abs(st._t_sf(2.0, 5) - 0.050969739414929) < 1e-9
    assert abs(st._t_sf(2.0, 10) - 0.036694017385370) < 1e-9


def test_bootstrap_ci_brackets_mean(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.2217, 0.0033, 0.1209, 0.0036, 0.0022])],
                               "g int, i int, v double")
    r = st.bootstrap_ci(df, ["g"], "v", ["i"], n_boot=2000).collect()[0]
    assert r["ci_lo"] <= r["mean"] <= r["ci_hi"]
    assert abs(r["mean"] - 0.07034) < 1e-9


def test_integrated_gradients_completeness(spark):
    from detecteval.operators import explain as ex
    from detecteval.operators import models as md
    c = fx.corpus(spark, SF).select("row_id", "func", "label")
    tf = md.fit_tfidf(c, 500)
    w = tf.vocab.select("term", "idx", ((F.col("idx") % 7) / 10.0 - 0.3).alias("coef"))
    ig = ex.integrated_gradients_linear(tf, w, -1.0, c)
    g = ig.groupBy("row_id").agg(F.sum("attribution").alias("s"), F.first("delta_prob").alias("d"))
    assert g.filter(F.abs(F.col("s") - F.col("d")) > 1e-9).count() == 0


def test_temperature_does_not_change_max_f1(spark):
    from detecteval.operators import calibrate as cb
    pt = fx.scored_events(spark, SF).filter(F.col("model") == "m0") \
        .withColumn("margin", F.col("logit1") - F.col("logit0"))
    f1s = []
    for T in (0.5, 3.0):
        s = pt.withColumn("score", F.lit(1.0) / (1 + F.exp(-F.col("margin") / T)))
        thr = cv.threshold_max_f1(cv.pr_curve(s, ["model"]), ["model"])
        f1s.append(cv.metrics_from_confusion(cv.confusion_at(cv.score_table(s, ["model"]), thr, ["model"]))
                   .collect()[0]["f1"])
    assert abs(f1s[0] - f1s[1]) < 1e-12
    temps = cb.fit_temperature(pt, ["model"]).collect()[0]
    assert 0.1 <= temps["T"] <= 10.0


def test_density_valley_bimodal(spark):
    from detecteval.operators.calibrate import density_valley_threshold
    rows = [(i, 0.1 + 0.05 * ((i * 7) % 10) / 10.0) for i in range(200)] + \
           [(200 + i, 0.8 + 0.05 * ((i * 3) % 10) / 10.0) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, score double").withColumn("g", F.lit(1))
    t = density_valley_threshold(df, ["g"]).collect()[0]["thr_valley"]
    assert 0.2 < t < 0.8


def test_budget_recall_matches_brute_force_with_ties(spark):
    from detecteval.operators.cost import budget_recall
    rows = [(i, int(py_hash(1, "l", i) % 4 == 0), (py_hash(1, "s", i) % 7) / 10.0) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, label int, score double").withColumn("g", F.lit("a"))
    got = {r["budget"]: r["found"] for r in budget_recall(df, ["g"], [1, 7, 50, 133, 400, 1000]).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    for b, f in got.items():
        assert f == sum(r[1] for r in order[:min(b, len(order))]), b


def test_random_split_sizes_are_exact(spark):
    import math as m
    df = spark.range(1003).withColumnRenamed("id", "row_id") \
        .withColumn("label", (H(3, "lab", F.col("row_id")) % 5 == 0).cast("int"))
    s = sa.random_split(df, seed=4)
    c = dict(s.groupBy("split").count().collect())
    n_test = m.ceil(1003 * 0.2)
    assert c["test"] == n_test
    assert c["val"] == m.ceil((1003 - n_test) * (0.1 / 0.8))
    assert sum(c.values()) == 1003
