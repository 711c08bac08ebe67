"""Threshold-transfer reports (T4, A17, A18, A25, A26, C7; R10, R16).

Input is a prediction table with sides: ``keys + [side, project, label,
score]`` where side is ``val`` (source calibration rows) or ``test``
(held-out groups). All (model, seed, fold) runs are evaluated by the same
keyed aggregations: one curve keyed by (keys, side), one keyed by
(keys, project) on the test side, and confusion counts for every threshold
kind in one join.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import verdict
from ..operators import curves as cv

RUN_KEYS = ["model", "seed", "fold"]
ROUND = 9


def _pivot_metrics(m: DataFrame, keys: Sequence[str], kinds: Sequence[str],
                   cols: Sequence[str]) -> DataFrame:
    aggs = []
    for k in kinds:
        for c in cols:
            aggs.append(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}"))
    return m.groupBy(*keys).agg(*aggs)


def run_thresholds(curve: DataFrame, keys: Sequence[str], min_precision: float = 0.3) -> DataFrame:
    """Per run: source/oracle max-F1 thresholds and precision-constrained ones."""
    keys = list(keys)
    val = curve.filter(F.col("side") == "val")
    test = curve.filter(F.col("side") == "test")
    runs = test.select(*keys).distinct()
    t_src = cv.threshold_max_f1(val, keys, name="thr_source")
    t_or = cv.threshold_max_f1(test, keys, name="thr_oracle")
    p_src = cv.threshold_at_precision(val, keys, min_precision, name="thr_p30_source")
    p_tgt = cv.threshold_at_precision(test, keys, min_precision, name="thr_p30_target")
    out = runs
    for t in (t_src, t_or, p_src, p_tgt):
        out = out.join(t, keys, "left")
    return out.select(*keys,
                      F.coalesce("thr_source", F.lit(0.5)).alias("thr_source"),
                      F.coalesce("thr_oracle", F.lit(0.5)).alias("thr_oracle"),
                      F.coalesce("thr_p30_source", F.lit(1.0)).alias("thr_p30_source"),
                      F.coalesce("thr_p30_target", F.lit(1.0)).alias("thr_p30_target"))


def per_project(pt: DataFrame, thr: DataFrame, keys: Sequence[str] = RUN_KEYS,
                min_pos: int = 2, min_rows: int = 10, n_buckets: int | None = None) -> DataFrame:
    """Per held-out group with >= min_pos positives and >= min_rows rows: own
    max-F1 threshold, F1 at the source threshold and at its own, gap (A17)."""
    keys = list(keys)
    pk = keys + ["project"]
    test = pt.filter(F.col("side") == "test")
    agg = cv.materialised_score_table(test, pk)
    if n_buckets is None:
        n_buckets = cv.choose_buckets(agg, pk)
    sizes = agg.groupBy(*pk).agg(F.sum("pos").alias("n_pos"),
                                 (F.sum("pos") + F.sum("neg")).alias("n"))
    elig = sizes.filter((F.col("n_pos") >= min_pos) & (F.col("n") >= min_rows))
    agg_e = agg.join(elig.select(*pk), pk, "left_semi")
    curve = cv.descending_running_sums(agg_e, pk, "score", ["pos", "neg"], n_buckets)
    curve = curve.select(*pk, "score", "pos", "neg", F.col("cum_pos").alias("tp"),
                         F.col("cum_neg").alias("fp"), F.col("tot_pos").alias("n_pos"))
    p = F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    r = F.col("tp").cast("double") / F.col("n_pos").cast("double")
    curve = curve.withColumn("f1", F.lit(2.0) * p * r / (p + r + F.lit(cv.EPS_F1)))
    own = cv.threshold_max_f1(curve, pk, name="thr_optimal")
    src = elig.select(*pk).join(thr.select(*keys, "thr_source"), keys)
    ths = (own.select(*pk, F.lit("own").alias("kind"), F.col("thr_optimal").alias("threshold"))
           .unionByName(src.select(*pk, F.lit("src").alias("kind"),
                                   F.col("thr_source").alias("threshold"))))
    m = cv.metrics_from_confusion(cv.confusion_at(agg_e, ths, pk))
    wide = _pivot_metrics(m, pk, ["own", "src"], ["f1"])
    return (elig.join(own, pk).join(wide, pk)
            .select(*pk, "n", (F.col("n_pos") / F.col("n")).alias("vuln_rate"), "thr_optimal",
                    F.col("f1_src").alias("f1_at_source_thr"),
                    F.col("f1_own").alias("f1_at_project_oracle"),
                    (F.col("f1_own") - F.col("f1_src")).alias("f1_gap")))


def threshold_transfer_runs(pt: DataFrame, keys: Sequence[str] = RUN_KEYS,
                            min_precision: float = 0.3, n_buckets: int | None = None,
                            with_projects: bool = True) -> DataFrame:
    """One row per run: thresholds, F1/recall/precision at source, oracle,
    fixed 0.5 and precision-0.3 points, and the per-group roll-up (T4, C7,
    A18). Floating roll-ups (std, mean) are rounded to 9 digits."""
    keys = list(keys)
    ks = keys + ["side"]
    agg = cv.materialised_score_table(pt, ks)
    curve = cv.pr_curve(pt, ks, n_buckets=n_buckets, agg=agg)
    thr = run_thresholds(curve, keys, min_precision)
    kinds = {"source": "thr_source", "oracle": "thr_oracle", "p30_source": "thr_p30_source",
             "p30_target": "thr_p30_target"}
    ths = None
    for kind, c in kinds.items():
        t = thr.select(*keys, F.lit(kind).alias("kind"), F.col(c).alias("threshold"))
        ths = t if ths is None else ths.unionByName(t)
    ths = ths.unionByName(thr.select(*keys, F.lit("fixed").alias("kind"),
                                     F.lit(0.5).alias("threshold")))
    test_agg = agg.filter(F.col("side") == "test").drop("side")
    m = cv.metrics_from_confusion(cv.confusion_at(test_agg, ths, keys))
    wide = _pivot_metrics(m, keys, ["source", "oracle", "fixed", "p30_source", "p30_target"],
                          ["f1", "recall", "precision"])
    sizes = agg.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == "val", F.col("pos") + F.col("neg")).otherwise(0)).alias("n_val"),
        F.sum(F.when(F.col("side") == "test", F.col("pos") + F.col("neg")).otherwise(0)).alias("n_test"),
        F.sum(F.when(F.col("side") == "test", F.col("pos")).otherwise(0)).alias("_tp"))
    nproj = (pt.filter(F.col("side") == "test").groupBy(*keys)
             .agg(F.countDistinct("project").alias("test_projects")))
    runs = (thr.join(wide, keys).join(sizes, keys).join(nproj, keys)
            .select(*keys, "n_val", "n_test", "test_projects",
                    (F.col("_tp") / F.col("n_test")).alias("test_vuln_rate"),
                    "thr_source", "thr_oracle",
                    F.abs(F.col("thr_oracle") - F.col("thr_source")).alias("thr_gap"),
                    F.col("f1_fixed").alias("f1_fixed_05"),
                    F.col("f1_source"), F.col("f1_oracle"),
                    (F.col("f1_oracle") - F.col("f1_source")).alias("f1_gap"),
                    "recall_source", "recall_oracle",
                    (F.col("recall_oracle") - F.col("recall_source")).alias("recall_gap"),
                    "precision_source", "precision_oracle",
                    F.col("f1_p30_source").alias("f1_at_p30_source_thr"),
                    F.col("f1_p30_target").alias("f1_at_p30_target_thr"),
                    (F.col("f1_p30_target") - F.col("f1_p30_source")).alias("p30_gap")))
    if not with_projects:
        return runs
    pp = per_project(pt, thr, keys, n_buckets=n_buckets)
    roll = pp.groupBy(*keys).agg(
        F.round(F.stddev_pop("thr_optimal"), ROUND).alias("per_project_thr_std"),
        F.min("thr_optimal").alias("per_project_thr_min"),
        F.max("thr_optimal").alias("per_project_thr_max"),
        F.round(F.avg("f1_gap"), ROUND).alias("per_project_f1_gap_mean"),
        F.max("f1_gap").alias("per_project_f1_gap_max"),
        F.count(F.lit(1)).alias("n_projects_evaluated"),
        F.sum(F.when(F.col("f1_gap") > 0.1, 1).otherwise(0)).alias("n_projects_with_gap_gt_01"))
    out = runs.join(roll, keys, "left")
    return out.withColumn("n_projects_evaluated", F.coalesce("n_projects_evaluated", F.lit(0))) \
        .withColumn("n_projects_with_gap_gt_01", F.coalesce("n_projects_with_gap_gt_01", F.lit(0)))


def top_projects(pp: DataFrame, keys: Sequence[str] = RUN_KEYS, n: int = 20) -> DataFrame:
    """First ``n`` per-group rows per run by (f1_gap desc, project).

    A top-k report: the limit is the feature."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col("f1_gap").desc(), F.col("project"))
    return pp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def transfer_summary(runs: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per model: mean gap, mean F1 at source, mean per-group gap over runs
    that have one (NULL-aware, D7), run count, verdict band (A25, A26)."""
    keys = list(keys)
    g = runs.groupBy(*keys).agg(
        F.round(F.avg("f1_gap"), ROUND).alias("mean_f1_gap"),
        F.round(F.stddev_pop("f1_gap"), ROUND).alias("std_f1_gap"),
        F.round(F.avg("thr_gap"), ROUND).alias("mean_thr_gap"),
        F.round(F.avg("f1_source"), ROUND).alias("mean_f1_at_source"),
        F.round(F.avg("per_project_f1_gap_mean"), ROUND).alias("mean_per_project_gap"),
        F.round(F.avg("per_project_thr_std"), ROUND).alias("mean_per_project_thr_std"),
        F.count(F.lit(1)).alias("n_runs"))
    return g.withColumn("verdict", verdict("mean_f1_gap"))


def summary_with_ci(runs: DataFrame, keys: Sequence[str] = ("model",), n_boot: int = 10000,
                    min_runs: int = 3) -> DataFrame:
    """Run summary with a bootstrap CI of the mean gap when there are at
    least ``min_runs`` runs, else (0, 0) (A25)."""
    from ..operators.stats import bootstrap_ci
    keys = list(keys)
    s = transfer_summary(runs, keys)
    ci = bootstrap_ci(runs, keys, "f1_gap", ["seed", "fold"], n_boot=n_boot).select(*keys, "n", "ci_lo", "ci_hi")
    j = s.join(ci, keys)
    ok = F.col("n") >= min_runs
    return j.select(*s.columns, F.when(ok, F.col("ci_lo")).otherwise(F.lit(0.0)).alias("ci95_lo"),
                    F.when(ok, F.col("ci_hi")).otherwise(F.lit(0.0)).alias("ci95_hi"))
