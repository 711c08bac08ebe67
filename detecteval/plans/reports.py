"""Report queries composed from the operators (R11, R13, R15 and their roll-ups).

All take a prediction table with sides (``plans.pt``) and run every
(model, seed, fold) at once.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import calibrate as cb
from ..operators import cost as co
from ..operators import curves as cv
from ..operators import drift as dr
from ..session import checkpoint
from . import transfer as tr

RUN_KEYS = ["model", "seed", "fold"]
ROUND = 9
# Fixed value: target predicted-positive rate of the PPR method.
PPR_TARGET = 0.057


def chosen_fold(pt: DataFrame, seed: int = 0) -> DataFrame:
    """The fold with most distinct test groups for ``seed``."""
    per = (pt.filter((F.col("side") == "test") & (F.col("seed") == seed))
           .groupBy("seed", "fold").agg(F.countDistinct("project").alias("n_projects")))
    return per.groupBy("seed").agg(
        F.max_by("fold", F.struct("n_projects", -F.col("fold"))).alias("fold"))


def cost_inputs(pt: DataFrame, seed: int = 0):
    sel = chosen_fold(pt, seed)
    p = pt.join(sel, ["seed", "fold"])
    test_agg = cv.materialised_score_table(p.filter(F.col("side") == "test"), RUN_KEYS)
    val_curve = cv.pr_curve(p.filter(F.col("side") == "val"), RUN_KEYS)
    runs = test_agg.select(*RUN_KEYS).distinct()
    f1_thr = runs.join(cv.threshold_max_f1(val_curve, RUN_KEYS), RUN_KEYS, "left") \
        .withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return p, test_agg, f1_thr


def cost_study(pt: DataFrame, seed: int = 0) -> DataFrame:
    """Cost table per model and FN:FP ratio on the chosen fold (R11: C1-C3)."""
    _, test_agg, f1_thr = cost_inputs(pt, seed)
    return co.cost_table(test_agg, f1_thr, RUN_KEYS)


def cost_curves(pt: DataFrame, seed: int = 0, ratios: Sequence[int] = (10, 50)) -> DataFrame:
    """Expected cost on a 200-point grid in [.01, .99] at two ratios (C4)."""
    _, test_agg, _ = cost_inputs(pt, seed)
    g = co.cost_grid(test_agg, RUN_KEYS, ratios, 0.01, 0.99, 200)
    return g.select(*RUN_KEYS, "fn_fp_ratio", "j", "threshold", "expected_cost")


def budget_study(pt: DataFrame, seed: int = 0) -> DataFrame:
    """Recall within review budgets on the chosen fold."""
    p, _, _ = cost_inputs(pt, seed)
    return co.budget_recall(p.filter(F.col("side") == "test"), RUN_KEYS)


def cost_ranking(pt: DataFrame, seed: int = 0) -> DataFrame:
    """Model ranking by minimum expected cost per ratio."""
    t = cost_study(pt, seed).select(*RUN_KEYS, "fn_fp_ratio", "min_expected_cost")
    w = Window.partitionBy("seed", "fold", "fn_fp_ratio").orderBy("min_expected_cost", "model")
    return t.withColumn("rank", F.row_number().over(w))


METHODS = ["fixed_05", "source_calibrated", "ppr_adapted", "density_valley", "oracle"]


def adaptive_thresholds(pt: DataFrame, keys: Sequence[str] = RUN_KEYS,
                        target: float = PPR_TARGET) -> DataFrame:
    """Per run: fixed/source/oracle/PPR/density-valley thresholds and the
    F1, recall and precision each gives on the target rows (R13: T1, T2, T4)."""
    keys = list(keys)
    ks = keys + ["side"]
    curve = cv.pr_curve(pt, ks)
    thr = tr.run_thresholds(curve, keys)
    test = pt.filter(F.col("side") == "test")
    agg = cv.materialised_score_table(test, keys)
    ppr = cb.ppr_threshold(agg, keys, target)
    val = cb.density_valley_threshold(test, keys, agg=agg)
    t = thr.join(ppr, keys).join(val, keys)
    kinds = {"fixed_05": F.lit(0.5), "source_calibrated": F.col("thr_source"),
             "ppr_adapted": F.col("thr_ppr"), "density_valley": F.col("thr_valley"),
             "oracle": F.col("thr_oracle")}
    ths = None
    for k, c in kinds.items():
        x = t.select(*keys, F.lit(k).alias("kind"), c.alias("threshold"))
        ths = x if ths is None else ths.unionByName(x)
    m = cv.metrics_from_confusion(cv.confusion_at(agg, ths, keys))
    aggs = []
    for k in kinds:
        for c in ["f1", "recall", "precision"]:
            aggs.append(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}"))
    wide = m.groupBy(*keys).agg(*aggs)
    return t.select(*keys, "thr_source", "thr_oracle", "thr_ppr", "thr_valley").join(wide, keys)


def method_long(adaptive: DataFrame, keys: Sequence[str] = RUN_KEYS, few: DataFrame | None = None) -> DataFrame:
    """One row per (run, method) with its F1 (stack/unpivot, S11). ``few`` adds the
    few-label methods of :func:`temperature_study`, one for each calibration size."""
    out = adaptive.unpivot(list(keys), [f"f1_{m}" for m in METHODS], "method", "f1") \
        .withColumn("method", F.expr("substr(method, 4)"))
    if few is None:
        return out
    return out.unionByName(few.select(*keys, F.concat(F.lit("temperature_k"), F.col("cal_size")).alias("method"), "f1"))


def method_summary(adaptive: DataFrame, keys: Sequence[str] = RUN_KEYS, few: DataFrame | None = None) -> DataFrame:
    """Mean, population std, min, max, count of F1 per method."""
    return method_long(adaptive, keys, few).groupBy("method").agg(
        F.round(F.avg("f1"), ROUND).alias("mean_f1"),
        F.round(F.stddev_pop("f1"), ROUND).alias("std_f1"),
        F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"),
        F.count(F.lit(1)).alias("n"))


def gap_closed(adaptive: DataFrame, keys: Sequence[str] = RUN_KEYS,
               min_gap: float = 0.01, few: DataFrame | None = None) -> DataFrame:
    """Share of the source->oracle F1 gap each method recovers, over runs
    with a gap above ``min_gap`` (A22)."""
    lg = method_long(adaptive, keys, few).filter(~F.col("method").isin("source_calibrated", "oracle"))
    base = adaptive.select(*keys, "f1_source_calibrated", "f1_oracle") \
        .filter(F.col("f1_oracle") - F.col("f1_source_calibrated") > min_gap)
    j = lg.join(base, list(keys))
    pct = F.lit(100.0) * (F.col("f1") - F.col("f1_source_calibrated")) \
        / (F.col("f1_oracle") - F.col("f1_source_calibrated"))
    return j.groupBy("method").agg(F.round(F.avg(pct), ROUND).alias("mean_gap_closed_pct"),
                                   F.round(F.stddev_pop(pct), ROUND).alias("std_gap_closed_pct"),
                                   F.count(F.lit(1)).alias("n"))


def temperature_study(pt: DataFrame, sizes: Sequence[int] = (20, 50, 100, 200),
                      keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Temperature scaling with k labelled target rows (R13: T3, J9).

    Per (run, cal_size): fit T on the calibration draw, pick the max-F1
    threshold on the scaled calibration scores, evaluate on the rest. The rest of a
    draw is never made row by row: T and threshold do not tell rows of one margin apart,
    so the draw's counts are taken off those of all test rows.
    """
    from ..operators.sampling import calibration_rows
    keys = list(keys)
    test = pt.filter(F.col("side") == "test").withColumn(
        "margin", F.col("logit1") - F.col("logit0"))
    cal = checkpoint(calibration_rows(test, sizes, F.col("seed") + F.col("fold"), keys)
                     .select(*keys, "cal_size", "label", "margin"))
    kk = keys + ["cal_size"]
    temps = cb.fit_temperature(cal, kk)
    counts = [F.sum("label").cast("long").alias("pos"), F.count("label").alias("_known"), F.count(F.lit(1)).alias("_cnt")]
    every = checkpoint(test.groupBy(*keys, "margin").agg(*counts))

    def scaled(df, on, carry=()):
        return cb.apply_temperature(df, temps, on, name="score", carry=carry).withColumn("score", F.round("score", ROUND))
    near = scaled(cal, kk)
    thr = cv.threshold_max_f1(cv.pr_curve(near, kk), kk)
    drawn, whole = near.groupBy(*kk, "score").agg(*counts), scaled(every, keys, ["cal_size"])
    ev = (whole.select(*kk, "score", "pos", "_known", "_cnt")
          .unionByName(drawn.select(*kk, "score", *[(-F.col(c)).alias(c) for c in ("pos", "_known", "_cnt")]))
          .groupBy(*kk, "score").agg(*[F.sum(c).alias(c) for c in ("pos", "_known", "_cnt")]).where("_cnt > 0")
          .withColumn("pos", F.when(F.col("_known") > 0, F.col("pos")))
          .select(*kk, "score", "pos", (F.col("_cnt") - F.col("pos")).alias("neg")))
    m = cv.metrics_from_confusion(cv.confusion_at(ev, thr, kk))
    return m.join(temps, kk).select(*kk, "T", "threshold", "f1", "recall", "precision")


def drift_report(pt: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Divergence statistics with the transfer gap of each run (R15: V7, T4)."""
    runs = tr.threshold_transfer_runs(pt, keys, with_projects=False) \
        .select(*keys, "f1_gap", "f1_source", "f1_oracle", "test_projects", "test_vuln_rate")
    return runs.join(dr.divergence(pt, keys), list(keys))
