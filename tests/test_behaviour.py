"""Behaviour of the corpus, evaluation and text-edit operators, by exact counts."""
import re

import pytest
from hypothesis import given
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from detecteval.functions.hashing import py_hash
from detecteval.operators import curves as cv
from detecteval.operators import folds as fo
from detecteval.operators import perturb as pe
from detecteval.operators import stats as st
from detecteval.operators.losses import logit_diagnostics
from detecteval.operators.prep import ordinal_codes
from detecteval.operators.sampling import downsample_positives, hard_balance
from detecteval.sources.corpus import load_csv_corpus
from detecteval.sources.synthetic import synthetic_corpus

ROWS = "row_id long, func string, label int, project string, cwe string"


def labelled(spark, n, positives, groups=7):
    return spark.createDataFrame([(i, f"line {i};", int(i % n < positives), f"g{i * i % groups}", "") for i in range(n)], ROWS)


@pytest.mark.parametrize("positives", [1, 13, 60])
@pytest.mark.parametrize("seed", [0, 5])
def test_balanced_sample_has_twice_the_smaller_class(spark, positives, seed):
    out = hard_balance(labelled(spark, 90, positives), seed=seed).groupBy("label").count().collect()
    small = min(positives, 90 - positives)
    assert {r["label"]: r["count"] for r in out} == {0: small, 1: small}


@pytest.mark.parametrize("positives", [8, 40, 150])
def test_downsampling_keeps_all_negatives(spark, positives):
    out = downsample_positives(labelled(spark, 400, positives), ratio=0.05, seed=1)
    kept = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert kept[0] == 400 - positives
    assert kept[1] <= positives and abs(kept[1] / sum(kept.values()) - min(0.05, positives / 400)) < 0.01


@pytest.mark.parametrize("folds,seeds", [(3, [0]), (5, [2, 9])])
def test_every_group_is_held_out_once(spark, folds, seeds):
    df = labelled(spark, 350, 60, groups=29)
    table = fo.group_folds(df, folds, seeds)
    per = table.groupBy("seed", "project").agg(F.countDistinct("fold").alias("k"), F.count("*").alias("n"))
    assert per.where("k <> 1 or n <> 1").count() == 0
    assert table.select("fold").distinct().count() == folds
    assert fo.leak_check(fo.assign_folds(df, table)).count() == 0
    with pytest.raises(ValueError):
        fo.group_folds(df, 1000, [0])


@given(hs.dictionaries(hs.sampled_from([1, 2, 3, 4, 6, 7, 11, 40]), hs.integers(1, 40), min_size=1),
       hs.integers(1, 6))
def test_class_cycles_are_the_lightest_fold_rule(classes, k):
    loads = [0] * k
    for n, starts, cycles in fo._class_cycles(list(classes.items()), k):
        for r in range(classes[n]):
            s = sum(x <= r for x in starts) - 1
            f = cycles[s][(r - starts[s]) % len(cycles[s])]
            assert f == loads.index(min(loads))
            loads[f] += n


def test_more_groups_than_any_list_follow_the_same_rule(spark):
    """12,000 groups: one large, the others of one or two rows."""
    df = (spark.range(12_000).withColumn("project", F.concat(F.lit("g"), "id"))
          .withColumn("n", F.when(F.col("id") == 0, 9_000).when(F.col("id") % 7 == 0, 2).otherwise(1))
          .selectExpr("project", "explode(sequence(1, n)) as i", "0 as label"))
    sizes = {r["project"]: r["n"] for r in fo.group_sizes(df).collect()}
    order = sorted(sizes, key=lambda g: (-sizes[g], py_hash(3, "fold", g), g))
    loads, want = [0] * 5, {}
    for g in order:
        want[g] = loads.index(min(loads))
        loads[want[g]] += sizes[g]
    assert {r["project"]: r["fold"] for r in fo.group_folds(df, 5, [3]).collect()} == want


def test_validation_groups_of_one_class_fall_back_to_all_rows(spark):
    def split(rows):
        df = spark.createDataFrame(rows, "row_id long, project string, label int")
        train, val = fo.validation_by_fraction(df, 0.3, 0)
        return {r["row_id"] for r in train.collect()}, {r["row_id"] for r in val.collect()}
    mixed = [(i, f"p{i % 4}", i // 4 % 2) for i in range(16)]
    train, val = split(mixed)
    assert len(val) == 4 and train | val == set(range(16)) and not train & val
    train, val = split([(i, p, 0) for i, p, _ in mixed])
    assert len(train) == 12 and val == set(range(16))


def test_best_predictor_prefers_the_first_of_equals(spark):
    def best(rows):
        return [tuple(r) for r in st.best_predictor(
            spark.createDataFrame(rows, "metric string, rho double, n long"), ["a", "b", "c"]).collect()]
    assert best([("c", 0.5, 9), ("b", -0.5, 9), ("a", 0.1, 9)]) == [("b", -0.5, 9, True)]
    assert best([("a", 0.4, 9), ("b", None, 9), ("c", float("nan"), 9)]) == [("a", 0.4, 9, False)]
    assert best([("a", 0.0, 9)]) == []


def test_buckets_grow_with_the_distinct_scores(spark):
    agg = spark.range(1000).selectExpr("id % 3 as k", "id as score")
    assert [cv.choose_buckets(agg, ["k"], n) for n in (1000, 100, 10)] == [1, 4, 34]


def test_generated_corpus_depends_on_its_seed_only(spark):
    one, two = (synthetic_corpus(spark.newSession(), 120, seed=4).orderBy("row_id").collect() for _ in range(2))
    assert [tuple(r) for r in one] == [tuple(r) for r in two]
    assert {r["label"] for r in one} == {0, 1} and all(r["func"] for r in one)


def scored(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label int, score double").withColumn("run", F.lit("r"))


def test_low_scores_collapse_at_a_half_and_recover_at_the_best_threshold(spark):
    rows = [(i, int(i >= 30), 0.001 * i) for i in range(40)]
    pt = scored(spark, rows)
    half = cv.compute_metrics(pt, ["run"], 0.5).first()
    assert half["collapsed"] and (half["tp"], half["fp"], half["fn"], half["tn"]) == (0, 0, 10, 30)
    best = cv.threshold_max_f1(cv.pr_curve(pt, ["run"]), ["run"]).first()["threshold"]
    assert best == 0.03
    at_best = cv.compute_metrics(pt, ["run"], best).first()
    assert (at_best["tp"], at_best["fp"], at_best["fn"], at_best["tn"]) == (10, 0, 0, 30)


def test_constant_and_moving_logits(spark):
    df = spark.createDataFrame([("flat", 1.5, 0.5)] * 9 + [("moving", 0.1 * i, 1.0) for i in range(9)],
                               "run string, logit0 double, logit1 double")
    got = {r["run"]: r["is_constant"] for r in logit_diagnostics(df, ["run"]).collect()}
    assert got == {"flat": True, "moving": False}


CODE = "long total(long *items, int count) {\n  long sum = 0;\n  int at = 0;\n  memset(items, 0, count);\n  return sum + at;\n}"


def test_rename_changes_declared_names_only(spark):
    out = spark.createDataFrame([(CODE,)], "func string").select(pe.rename_variables(F.col("func"), 3).alias("o")).first()["o"]
    before, after = re.findall(r"\w+", CODE), re.findall(r"\w+", out)
    assert len(before) == len(after)
    names = {"total", "items", "count", "sum", "at"}
    for x, y in zip(before, after):
        assert re.fullmatch(r"v\d+", y) if x in names else x == y
    assert len({y for x, y in zip(before, after) if x in names}) == len(names)


def test_dead_code_adds_lines_and_keeps_the_others(spark):
    out = spark.createDataFrame([(CODE,)], "func string").select(pe.insert_dead_code(F.col("func"), 4, 1).alias("o")).first()["o"]
    lines, left = out.split("\n"), CODE.split("\n")
    assert len(lines) == len(left) + 4
    it = iter(lines)
    assert all(any(x == y for y in it) for x in left)


def test_token_drift_reads_the_whole_text(spark):
    long = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(long + " int a = 1; a", long + " int a = 1; b", "k")], "func string, func_perturbed string, kind string")
    r = pe.token_drift(df).first()
    assert (r["n_changed"], r["n_changed_no_blank"]) == (1, 1)


def brute_wilcoxon(d):
    d = [x for x in d if x]
    order = sorted(abs(x) for x in d)
    rank = [order.index(abs(x)) + (order.count(abs(x)) + 1) / 2 for x in d]
    plus = sum(r for x, r in zip(d, rank) if x > 0)
    w = min(plus, sum(rank) - plus)
    low = sum(sum(r for k, r in enumerate(rank) if bits >> k & 1) <= w for bits in range(2 ** len(d)))
    return w, min(1.0, 2 * low / 2 ** len(d))


@pytest.mark.parametrize("d", [[1, -2, 3, 0, 0, 4, 0], [1, 1, -1, 2, 2, -3, 4, 5, 5, -5, 6, 7, 7, 8, -9, 9, 10], [-1, -2, -3, -4, -5, -6]])
def test_signed_rank_test_is_exact_with_ties_and_zeros(spark, d):
    df = spark.createDataFrame([("t", float(x), 0.0) for x in d], "t string, a double, b double")
    r = st.wilcoxon(df, ["t"], "a", "b").first()
    w, p = brute_wilcoxon(d)
    assert r["statistic"] == w and abs(r["p_value"] - p) < 1e-12
    assert abs(st.wilcoxon(df, ["t"], "a", "b", method="normal").first()["p_value"] - p) < 0.15


def test_signed_rank_test_without_a_p(spark):
    df = spark.createDataFrame([("same", 1.0, 1.0)] * 6 + [("few", 1.0, 0.0)] * 4, "t string, a double, b double")
    got = {r["t"]: (r["n"], r["p_value"]) for r in st.wilcoxon(df, ["t"], "a", "b").collect()}
    assert got == {"same": (0, None), "few": (4, None)}


def test_codes_follow_the_order_of_values(spark):
    df = spark.createDataFrame([(x,) for x in "delta alpha echo alpha bravo".split()] + [(None,)], "v string")
    got = {(r["v"], r["code"]) for r in ordinal_codes(df.repartition(4), "v").collect()}
    assert got == {("alpha", 0), ("bravo", 1), ("delta", 2), ("echo", 3), (None, None)}


def test_csv_ids_do_not_depend_on_partitions(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"{part}.csv").write_text("code,target,project\n" + "".join(f'"f{part}_{i};",{i % 2},p{i}\n' for i in range(20)))
    first = {(r["row_id"], r["func"]) for r in load_csv_corpus(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        second = {(r["row_id"], r["func"]) for r in load_csv_corpus(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == second and len({i for i, _ in first}) == 60
