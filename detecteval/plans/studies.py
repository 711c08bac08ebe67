"""Model-backed studies (rows-only checks): baselines, weight/balance grids,
perturbation robustness, counterfactuals and attributions (R1-R7, R12, R14).

Logistic regressions of all configurations and folds are fitted in one keyed job
(``operators.logistic``); forests, boosting and the linear models of the text studies
are Spark ML fits on TF-IDF features, one per model.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import H
from ..operators import curves as cv
from ..operators import explain as ex
from ..operators import models as md
from ..operators import perturb as pe
from ..operators.sampling import downsample_positives, hard_balance, random_split
from ..session import checkpoint, written
from . import fixtures as fx

ROUND = 9
#: Weights of the fixed call scorer.
CALL_WEIGHTS = {c: md.LEXICON[c] for c in ex.SINKS}


def _split_corpus(spark: SparkSession, sf_dir: str, code: bool = False) -> DataFrame:
    c = (fx.code_corpus if code else fx.corpus)(spark, sf_dir).select("row_id", "func", "label", "project", "cwe")
    return checkpoint(random_split(c, seed=0))


def _metrics_row(pt: DataFrame, thr_val: float, keys: Sequence[str]) -> DataFrame:
    m5 = cv.compute_metrics(pt, keys, 0.5).withColumn("thr_kind", F.lit("fixed_05"))
    mc = cv.compute_metrics(pt, keys, thr_val).withColumn("thr_kind", F.lit("calibrated"))
    return m5.unionByName(mc)


def _val_threshold(val_pt: DataFrame) -> float:
    cur = cv.pr_curve(val_pt.withColumn("_k", F.lit(1)), ["_k"])
    r = cv.threshold_max_f1(cur, ["_k"]).collect()
    return float(r[0]["threshold"]) if r else 0.5


def fit_protocol(spark: SparkSession, sf_dir: str, name: str = "lr", w1: float = 1.0,
                 balance: bool = False, code: bool = False,
                 settings: dict | None = None):
    """Fit on train, pick the max-F1 threshold on validation, score test (M7)."""
    s = _split_corpus(spark, sf_dir, code)
    train = s.filter(F.col("split") == "train")
    rest = s.filter(F.col("split") != "train")
    pt, tf, m = md.fit_score(train, rest, name, w1, balance, settings=settings)
    pt = checkpoint(pt)
    thr = _val_threshold(pt.filter(F.col("split") == "val"))
    return pt, thr, tf, m, s


def simple_baselines(spark: SparkSession, sf_dir: str, models=("lr", "rf", "gbt"),
                     settings: dict | None = None) -> DataFrame:
    """TF-IDF + LR / RF / GBT on the random split: metrics at 0.5 and at the
    validation threshold (R14, R4). ``settings`` passes classifier sizes to
    ``make_classifier``; without it they are the full ones of the study."""
    s = _split_corpus(spark, sf_dir)
    train, rest = s.filter(F.col("split") == "train"), s.filter(F.col("split") != "train")
    tf = md.fit_tfidf(train)
    train, rest = md.features(tf, train), md.features(tf, rest)  # the same for all models
    out = None
    for name in models:
        pt = checkpoint(md.fit_vectors(train, rest, name, settings=settings)[0])
        thr = _val_threshold(pt.filter(F.col("split") == "val"))
        test = pt.filter(F.col("split") == "test").withColumn("model", F.lit(name))
        nat = _metrics_row(test, thr, ["model"]).withColumn("test_kind", F.lit("natural"))
        down = downsample_positives(test, 0.05, 0)
        dn = _metrics_row(down, thr, ["model"]).withColumn("test_kind", F.lit("downsampled"))
        r = nat.unionByName(dn)
        out = r if out is None else out.unionByName(r)
    return out


def _plan(spark: SparkSession, fits: Sequence[tuple]) -> DataFrame:
    """(fit, task, w1) of a literal list of (task, w1)."""
    return spark.createDataFrame([(i, t, float(w)) for i, (t, w) in enumerate(fits)], "fit int, task int, w1 double")


def _rounded(pt: DataFrame) -> DataFrame:
    """Scores on a grid of six digits: the fits agree to about 1e-9 however they were
    found, so ties and thresholds do not hang on the last bits."""
    return checkpoint(pt.withColumn("score", F.round("score", 6)).withColumn("margin", F.round("margin", 6)))


def _test_kinds(pt: DataFrame, kinds: Sequence[str], keys: Sequence[str] = ("fit",), ratio: float = 0.05) -> DataFrame:
    """Test rows as they are (natural) and with positives down-sampled to 95:5."""
    test = pt.where("side = 'test'")
    parts = {"natural": test, "downsampled": downsample_positives(test, ratio, 0, keys)}
    out = [parts[k].withColumn("test_kind", F.lit(k)) for k in kinds]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def weight_balance_grid(spark: SparkSession, sf_dir: str, weights=(1.0, 30.0), balances=(False, True),
                        tol: float = 1e-8) -> DataFrame:
    """Balance x class weight x test kind, with logit diagnostics (R1, R2; K5, M5,
    M6). Every cell is one fit of a single keyed job; a balanced task has the
    vocabulary of its own rows."""
    from ..operators.logistic import run_protocol
    from ..operators.losses import logit_diagnostics
    s = _split_corpus(spark, sf_dir)
    train = s.where("split = 'train'").select("row_id", "label")
    other = s.where("split <> 'train'").select("row_id", F.col("split").alias("side"))
    sides = None
    for task, balanced in enumerate(balances):
        rows = hard_balance(train, 0) if balanced else train
        part = (rows.select("row_id", F.lit("train").alias("side")).unionByName(other)
                .select(F.lit(task).alias("task"), "row_id", "side"))
        sides = part if sides is None else sides.unionByName(part)
    fits = [(task, w) for task in range(len(balances)) for w in weights]
    pt = _rounded(run_protocol(s.select("row_id", "label", "func"), checkpoint(sides), _plan(spark, fits), tol=tol))
    test = checkpoint(_test_kinds(pt, ("natural", "downsampled")))
    both = pt.where("side = 'val'").withColumn("test_kind", F.explode(F.array(F.lit("natural"), F.lit("downsampled"))))
    keys = ["fit", "test_kind"]
    m = cv.protocol_metrics(both, keys, test).join(
        logit_diagnostics(test.select(*keys, "label", F.lit(0.0).alias("logit0"), F.col("margin").alias("logit1")), keys), keys)
    cells = F.create_map(*[F.lit(x) for i, (t, w) in enumerate(fits) for x in (i, f"balance={balances[t]},w1={w}")])
    return m.withColumn("cell", cells[F.col("fit")]).drop("fit")


def robustness(spark: SparkSession, sf_dir: str, kinds=("rename", "deadcode", "whitespace",
                                                        "whitespace_safe"),
               n_variants: int = 2) -> DataFrame:
    """F1 under each perturbation vs clean, absolute and relative drop, mean
    over variants, token drift share (R5: X1-X6, A19, A21)."""
    pt, thr, tf, m, s = fit_protocol(spark, sf_dir, "lr", code=True)
    weights = md.linear_weights(tf, m)
    scorer = ex.make_linear_scorer(tf, weights, float(m.intercept))
    test = s.filter(F.col("split") == "test").select("row_id", "func", "label", "cwe")
    clean = scorer(test, "func", "score")
    clean_f1 = cv.compute_metrics(clean.withColumn("_k", F.lit(1)), ["_k"], thr) \
        .select("f1").collect()[0][0]  # one scalar
    p = pe.perturb(test, kinds, seed=0, n_variants=n_variants)
    p = p.withColumn("_key", F.concat_ws("#", "row_id", "kind", "variant"))
    sc = scorer(p.select(F.col("_key").alias("row_id"), F.col("func_perturbed").alias("func")),
                "func", "score").select(F.col("row_id").alias("_key"), "score")
    ps = p.join(sc, "_key")
    per = cv.compute_metrics(ps, ["kind", "variant"], thr).select("kind", "variant", "f1")
    agg = per.groupBy("kind").agg(F.round(F.avg("f1"), ROUND).alias("f1"))
    drift = pe.token_drift(p, ["kind"])
    out = agg.withColumn("clean_f1", F.lit(round(float(clean_f1), ROUND))).join(drift, "kind")
    return out.withColumn("abs_drop", F.col("clean_f1") - F.col("f1")) \
        .withColumn("rel_drop_pct", F.lit(100.0) * (F.col("clean_f1") - F.col("f1"))
                    / F.greatest(F.col("clean_f1"), F.lit(1e-9)))


#: Edits whose draws SQL can state.
FIXED_KINDS = ("rename", "deadcode", "whitespace")


def _drops(m: DataFrame, clean) -> DataFrame:
    return m.withColumn("abs_drop", clean - F.col("f1")).withColumn(
        "rel_drop_pct", F.lit(100.0) * F.col("abs_drop") / F.greatest(clean, F.lit(1e-9)))


def robustness_fixed(spark: SparkSession, sf_dir: str, n_variants: int = 2) -> DataFrame:
    """F1 of the fixed call scorer on every row of the code corpus under each edit, mean
    over variants, absolute and relative drop from the clean F1 (R5: X1-X5, A19, A21)."""
    c = fx.code_corpus(spark, sf_dir).select("row_id", "label", "func")
    score = ex.make_call_scorer(CALL_WEIGHTS)
    p = pe.perturb(c, FIXED_KINDS, seed=0, n_variants=n_variants).drop("func")
    clean = c.select("row_id", "label", F.lit("clean").alias("kind"), F.lit(0).alias("variant"), F.col("func").alias("func_perturbed"))
    m = cv.compute_metrics(score(clean.unionByName(p), "func_perturbed", "score"), ["kind", "variant"], 0.5)
    per = m.groupBy("kind").agg(F.round(F.avg("f1"), ROUND).alias("f1"), F.count(F.lit(1)).alias("n_variants"))
    base = per.where("kind = 'clean'").select(F.col("f1").alias("clean_f1"), F.lit(list(FIXED_KINDS)).alias("kind"))
    base = base.withColumn("kind", F.explode("kind"))
    return _drops(per.join(base, "kind"), F.col("clean_f1"))


def category_robustness_fixed(spark: SparkSession, sf_dir: str, top: int = 10, min_rows: int = 10) -> DataFrame:
    """The same per category: the ten most frequent ones (blank counted, then dropped) of
    at least ``min_rows`` rows, with the drops from the category's clean F1 (R12: A20, W2)."""
    c = fx.code_corpus(spark, sf_dir).select("row_id", "label", "cwe", "func")
    cats = c.groupBy("cwe").count().orderBy(F.col("count").desc(), F.col("cwe")).limit(top) \
        .filter((F.col("cwe") != "") & (F.col("count") >= min_rows)).select("cwe")
    t = c.join(F.broadcast(cats), "cwe")  # ten rows at most
    p = pe.perturb(t, FIXED_KINDS, seed=0).drop("func", "variant")
    clean = t.select(*[x for x in t.columns if x != "func"], F.lit("clean").alias("kind"), F.col("func").alias("func_perturbed"))
    scored = ex.make_call_scorer(CALL_WEIGHTS)(clean.unionByName(p.select(*clean.columns)), "func_perturbed", "score")
    m = cv.compute_metrics(scored, ["cwe", "kind"], 0.5).select("cwe", "kind", "tp", "fp", "fn", "tn", "f1", "recall", "precision")
    base = m.where("kind = 'clean'").select("cwe", F.col("f1").alias("clean_f1"))
    return _drops(m.join(base, "cwe"), F.col("clean_f1"))


def per_category_robustness(spark: SparkSession, sf_dir: str, top: int = 10,
                            min_rows: int = 10) -> DataFrame:
    """Ten most frequent categories (blank counted, then dropped), >= 10 rows:
    F1 clean and per perturbation kind, with the drop from the clean F1
    (R12: A20, W2)."""
    pt, thr, tf, m, s = fit_protocol(spark, sf_dir, "lr", code=True)
    scorer = ex.make_linear_scorer(tf, md.linear_weights(tf, m), float(m.intercept))
    test = s.filter(F.col("split") == "test").select("row_id", "func", "label", "cwe")
    cats = test.groupBy("cwe").count().orderBy(F.col("count").desc(), F.col("cwe")).limit(top) \
        .filter((F.col("cwe") != "") & (F.col("count") >= min_rows)).select("cwe")
    t = test.join(F.broadcast(cats), "cwe")
    p = pe.perturb(t, ("rename", "deadcode", "whitespace"), seed=0)
    base = t.withColumn("kind", F.lit("clean")).withColumn("variant", F.lit(0)) \
        .withColumn("func_perturbed", F.col("func"))
    allp = base.unionByName(p.select(*base.columns))
    allp = allp.withColumn("_key", F.concat_ws("#", "row_id", "kind", "variant"))
    sc = scorer(allp.select(F.col("_key").alias("row_id"), F.col("func_perturbed").alias("func")),
                "func", "score").select(F.col("row_id").alias("_key"), "score")
    m = cv.compute_metrics(allp.join(sc, "_key"), ["cwe", "kind"], thr) \
        .select("cwe", "kind", "tp", "fp", "fn", "tn", "f1", "recall", "precision")
    clean = F.max(F.when(F.col("kind") == "clean", F.col("f1"))).over(Window.partitionBy("cwe"))
    return m.withColumn("abs_drop", clean - F.col("f1")).withColumn(
        "rel_drop_pct", F.lit(100.0) * F.col("abs_drop") / F.greatest(clean, F.lit(1e-9)))


def counterfactual_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives of the test split on the code corpus: sink removal flips and rates (R7, R12: E3, E4)."""
    pt, thr, tf, m, s = fit_protocol(spark, sf_dir, "lr", code=True)
    scorer = ex.make_linear_scorer(tf, md.linear_weights(tf, m), float(m.intercept))
    pos = s.filter((F.col("split") == "test") & (F.col("label") == 1)) \
        .select("row_id", "func", "label")
    cf = ex.counterfactual_sink_removal(pos, scorer)
    return ex.flip_rates(cf, pos)


def counterfactual_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sink removal on every row of the code corpus under the fixed call scorer:
    flip rates by label (E3, E4)."""
    c = fx.code_corpus(spark, sf_dir).select("row_id", "label", "func")
    cf = ex.counterfactual_sink_removal(c, ex.make_call_scorer(CALL_WEIGHTS))
    return ex.flip_rates(cf, c, ["label"]).withColumn("max_delta", F.round("max_delta", ROUND))


#: Intercept of the weight table of :func:`attributions_fixed`.
FIXED_INTERCEPT = 0.25


def attributions_fixed(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Top-k occlusion and integrated-gradient terms of every row under a stored weight
    table instead of a fitted one: a term's weight is ``(H(0, coef, term) % 2001 - 1000)
    / 250`` (E5, E6, W1). Values are rounded before they are ranked."""
    c = written(fx.corpus(spark, sf_dir).select("row_id", "func"))  # read by every step below
    tf = md.fit_tfidf(c)
    w = tf.vocab.select("term", "idx", ((H(0, "coef", F.col("term")) % 2001 - 1000).cast("double") / F.lit(250.0)).alias("coef"))
    parts = {"occlusion": ex.occlusion_linear(tf, w, FIXED_INTERCEPT, c).withColumn("value", F.round("delta", ROUND)),
             "integrated_gradients": ex.integrated_gradients_linear(tf, w, FIXED_INTERCEPT, c).withColumn(
                 "value", F.round("attribution", ROUND))}
    out = [ex.top_k_by_abs(t.select("row_id", "term", "value"), k, "value").withColumn("method", F.lit(m))
           for m, t in parts.items()]
    return out[0].unionByName(out[1])


def counterfactual_examples(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """For each sink the ``k`` rows whose score falls most when the sink is removed, under
    the fixed call scorer: a report of examples (R7, R12: E3, W3)."""
    c = fx.code_corpus(spark, sf_dir).select("row_id", "label", "cwe", "func")
    cf = ex.counterfactual_sink_removal(c, ex.make_call_scorer(CALL_WEIGHTS)).select(
        "sink", "row_id", "label", "cwe", "flipped", *[F.round(x, ROUND).alias(x) for x in ("p_before", "p_after", "delta")])
    w = Window.partitionBy("sink").orderBy(F.desc("delta"), "row_id")
    return cf.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def attribution_study(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Top-k occlusion and integrated-gradient terms for all positives of the test split
    (R7: E5, E6, W1, W3)."""
    pt, thr, tf, m, s = fit_protocol(spark, sf_dir, "lr", code=True)
    w = md.linear_weights(tf, m)
    pos = s.filter((F.col("split") == "test") & (F.col("label") == 1)) \
        .select("row_id", "func")
    occ = ex.top_k_by_abs(ex.occlusion_linear(tf, w, float(m.intercept), pos), k, "delta") \
        .select("row_id", "rank", "term", F.col("delta").alias("value")).withColumn("method", F.lit("occlusion"))
    ig = ex.top_k_by_abs(ex.integrated_gradients_linear(tf, w, float(m.intercept), pos), k, "attribution") \
        .select("row_id", "rank", "term", F.col("attribution").alias("value")) \
        .withColumn("method", F.lit("integrated_gradients"))
    return occ.unionByName(ig)


def tfidf_table(spark: SparkSession, sf_dir: str, max_features: int = 10_000) -> DataFrame:
    """Long TF-IDF of the prepared corpus (M1)."""
    c = fx.corpus(spark, sf_dir).select("row_id", "func")
    tf = md.fit_tfidf(c, max_features)
    return md.transform_tfidf(tf, c)


def cross_project_runs(spark: SparkSession, sf_dir: str, n_splits: int = 5, seeds: Sequence[int] = (0, 1, 2),
                       val_frac: float = 0.15, tol: float = 1e-8) -> DataFrame:
    """Leave-groups-out runs (R3): for every (seed, fold) a logistic regression on the
    other groups minus the validation groups, its threshold from those (J6), metrics on
    the held-out groups at 0.5 and at that threshold. All vocabularies, fits and
    thresholds are keyed by (seed, fold) in one job each."""
    from ..operators import folds as fo
    from ..operators.logistic import run_protocol
    c = checkpoint(fx.corpus(spark, sf_dir).select("row_id", "func", "label", "project"))
    folds = checkpoint(fo.group_folds(c.select("project", "label"), n_splits, list(seeds)))
    place = F.create_map(*[F.lit(x) for i, seed in enumerate(seeds) for x in (int(seed), i * n_splits)])
    sides = fo.cross_group_sides(c, folds, val_frac).select(
        (place[F.col("seed")] + F.col("fold")).cast("int").alias("task"), "row_id", "side")
    fits = len(seeds) * n_splits
    pt = _rounded(run_protocol(c.select("row_id", "label", "func"), checkpoint(sides),
                               _plan(spark, [(i, 1.0) for i in range(fits)]), tol=tol))
    m = cv.protocol_metrics(pt, ["fit"])
    seed = F.element_at(F.array(*[F.lit(int(x)) for x in seeds]), (F.floor(F.col("fit") / n_splits) + 1).cast("int"))
    return m.select(seed.alias("seed"), (F.col("fit") % n_splits).alias("fold"), *[x for x in m.columns if x != "fit"])


def cross_project_cv(spark: SparkSession, sf_dir: str, n_splits: int = 5, seeds: Sequence[int] = (0, 1, 2),
                     n_boot: int = 10000) -> DataFrame:
    """Summary of :func:`cross_project_runs` over seeds and folds (R3, R14: J4, J6, K1,
    K2, K4, M7, A10, A11, A13): for each threshold kind and metric (f1, recall) mean,
    standard deviation and bootstrap interval, and the paired Wilcoxon test of the two
    kinds."""
    from ..operators import stats as st
    runs = checkpoint(cross_project_runs(spark, sf_dir, n_splits, seeds))
    long = runs.select("seed", "fold", "thr_kind", F.expr("stack(2, 'f1', f1, 'recall', recall) as (metric, value)"))
    ci = st.bootstrap_ci(long, ["metric", "thr_kind"], "value", ["seed", "fold"], n_boot=n_boot)
    spread = long.groupBy("metric", "thr_kind").agg(F.round(F.stddev_pop("value"), ROUND).alias("std"))
    pairs = (long.groupBy("metric", "seed", "fold").pivot("thr_kind", ["calibrated", "fixed_05"]).agg(F.first("value")))
    paired = st.wilcoxon(pairs, ["metric"], "calibrated", "fixed_05").select(
        "metric", F.col("statistic").alias("wilcoxon_w"), F.col("p_value").alias("wilcoxon_p"),
        F.col("n").alias("wilcoxon_n"))
    return ci.join(spread, ["metric", "thr_kind"]).join(paired, "metric", "left")


# Class weights of the weight sweep.
SWEEP_WEIGHTS = [1.0, 10.0, 20.0, 30.0, 50.0, 100.0]


def weight_sweep(spark: SparkSession, sf_dir: str, weights: Sequence[float] = SWEEP_WEIGHTS,
                 test_ratio: float = 0.05, tol: float = 1e-8) -> DataFrame:
    """Logistic regression per positive-class weight, evaluated on a 95:5
    down-sampled test set at 0.5 and at the validation threshold (R6: M5, J8). One
    keyed job fits all weights."""
    from ..operators.logistic import run_protocol
    s = _split_corpus(spark, sf_dir)
    sides = s.select(F.lit(0).alias("task"), "row_id", F.col("split").alias("side"))
    pt = _rounded(run_protocol(s.select("row_id", "label", "func"), sides,
                               _plan(spark, [(0, w) for w in weights]), tol=tol))
    test = checkpoint(_test_kinds(pt, ["downsampled"], ratio=test_ratio).drop("test_kind"))
    m = cv.protocol_metrics(pt, ["fit"], test)
    return m.withColumn("w1", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("fit") + 1)).drop("fit")
