"""Statistics over run tables: bootstrap CI, Wilcoxon, Spearman, fits,
box-plot tables (A10-A13, A23, A24).

Run tables are small (one row per model x seed x fold), but every function
is still keyed so many studies run in one job; resampling tables are
generated with ``sequence`` + ``explode`` (bounded multipliers).
"""
from __future__ import annotations

import math
from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import H

ROUND = 9


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                 n_boot: int = 10000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile bootstrap CI of the mean per group (A10).

    Draw ``j`` of resample ``b`` is the value at index ``H(seed,b,j) % n``;
    resample means are rounded to 12 digits, percentiles are linear.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    vals = df.select(*keys, F.col(value).alias("_v"),
                     (F.row_number().over(w) - 1).alias("_idx"),
                     F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    sizes = vals.groupBy(*keys).agg(F.first("_n").alias("_n"), F.avg("_v").alias("_mean"))
    draws = (sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
             .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    draws = draws.withColumn("_idx", (H(seed, "boot", F.col("_b"), F.col("_j")) % F.col("_n")).cast("int"))
    means = (draws.join(vals.select(*keys, "_idx", "_v"), keys + ["_idx"])
             .groupBy(*keys, "_b").agg(F.round(F.avg("_v"), 12).alias("_m")))
    q = means.groupBy(*keys).agg(F.percentile("_m", [alpha / 2, 1 - alpha / 2]).alias("_q"))
    return sizes.join(q, keys).select(
        *keys, F.col("_n").alias("n"), F.round("_mean", ROUND).alias("mean"),
        F.round(F.col("_q")[0], ROUND).alias("ci_lo"), F.round(F.col("_q")[1], ROUND).alias("ci_hi"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Mid-ranks (ties get the mean of their positions) within ``keys``."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(value))
    wt = Window.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)


def _wilcoxon_exact(ranks2: list, w: float) -> float:
    """Exact two-sided p of the signed-rank statistic (ranks doubled to
    integers): sign patterns counted by their sum, one rank after the other."""
    counts = {0: 1}
    for r in ranks2:
        nxt = dict(counts)
        for s, c in counts.items():
            nxt[s + r] = nxt.get(s + r, 0) + c
        counts = nxt
    low = sum(c for s, c in counts.items() if s <= round(2 * w))
    return min(1.0, 2.0 * low / 2 ** len(ranks2))


def _wilcoxon_normal(n: int, w: float, ties: float) -> float:
    """Normal form with the tie correction ``ties`` = sum of t^3 - t."""
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc(abs(w - n * (n + 1) / 4.0) / math.sqrt(2 * var)))


def wilcoxon(pairs: DataFrame, keys: Sequence[str], a: str, b: str, method: str = "exact",
             min_n: int = 5) -> DataFrame:
    """Wilcoxon signed-rank test of paired columns ``a``/``b`` per group.

    Zeros are dropped, |d| gets mid-ranks, W = min(W+, W-), p is two-sided. The
    caller chooses ``method``: ``exact`` counts all sign patterns at every n
    (for run tables: it gathers a group's ranks), ``normal`` works from
    aggregates with the tie correction. p is NULL for fewer than ``min_n``
    pairs, zeros counted, or when no pair differs.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"method must be exact or normal, not {method!r}")
    keys = list(keys)
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).filter(F.col("_d").isNotNull())
    n_pairs = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs"))
    r = average_ranks(d.filter("_d <> 0").withColumn("_ad", F.abs("_d")), keys, "_ad", "_r")
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
        *([F.sort_array(F.collect_list((F.col("_r") * 2).cast("long"))).alias("_x")] if method == "exact" else []))
    if method == "normal":
        t = r.groupBy(*keys, "_ad").agg(F.count(F.lit(1)).cast("double").alias("_t"))
        g = g.join(t.groupBy(*keys).agg(F.sum(F.pow("_t", F.lit(3.0)) - F.col("_t")).alias("_x")), keys)
    g = n_pairs.join(g, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    g = g.withColumn("statistic", F.least("w_plus", "w_minus"))

    @F.pandas_udf("double")
    def pval(n_all: pd.Series, n: pd.Series, x: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for total, used, extra, ww in zip(n_all, n, x, w):
            if total < min_n or not used:
                out.append(None)
            elif method == "exact":
                out.append(_wilcoxon_exact([int(v) for v in extra], float(ww)))
            else:
                out.append(_wilcoxon_normal(int(used), float(ww), float(extra)))
        return pd.Series(out, dtype="float64")

    return g.withColumn("p_value", pval("_pairs", "n", "_x", "statistic")).drop("_x", "_pairs")


def _t_sf(t: float, df: int) -> float:
    """Survival function of Student's t for integer df (finite series)."""
    # Closed-form series in theta = atan(|t| / sqrt(df)).
    th = math.atan(abs(t) / math.sqrt(df))
    if df % 2 == 1:
        s = 0.0
        if df > 1:
            term = math.cos(th)
            s = term
            for k in range(3, df, 2):
                term *= (k - 1) / k * math.cos(th) ** 2
                s += term
            s *= math.sin(th)
        p2 = 1 - (2 / math.pi) * (th + s)
    else:
        term = 1.0
        s = 1.0
        for k in range(2, df, 2):
            term *= (k - 1) / k * math.cos(th) ** 2
            s += term
        p2 = 1 - math.sin(th) * s
    return max(0.0, min(1.0, p2)) / 2.0


def spearman(df: DataFrame, metrics: Sequence[str], target: str) -> DataFrame:
    """Spearman rho of each metric with ``target`` over all rows, with the
    number of distinct metric values and a two-sided t-based p (A12)."""
    long = df.unpivot([target], list(metrics), "metric", "value")
    r = average_ranks(average_ranks(long, ["metric"], "value", "_rv"), ["metric"], target, "_rt")
    g = r.groupBy("metric").agg(F.corr("_rv", "_rt").alias("_rho"),
                                F.count(F.lit(1)).alias("n"),
                                F.countDistinct("value").alias("n_distinct"))
    g = g.withColumn("rho", F.when(F.col("n_distinct") > 2, F.round("_rho", ROUND))).drop("_rho")

    @F.pandas_udf("double")
    def pv(rho: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for r_, n_ in zip(rho, n):
            if r_ is None or pd.isna(r_) or n_ <= 2:
                out.append(None)
            elif abs(r_) >= 1.0:
                out.append(0.0)
            else:
                t = r_ * math.sqrt((n_ - 2) / (1 - r_ * r_))
                out.append(2 * _t_sf(abs(t), int(n_ - 2)))
        return pd.Series(out, dtype="float64")

    return g.withColumn("p_value", pv("rho", "n"))


def best_predictor(rhos: DataFrame, metrics: Sequence[str], usable_above: float = 0.4) -> DataFrame:
    """The metric of largest |rho| (the first of ``metrics`` on ties) of a
    :func:`spearman` table, and whether |rho| is above ``usable_above`` (A12).
    No row when no metric has a rho other than 0."""
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    best = F.max_by(F.struct("metric", "rho", "n"), F.struct(F.abs("rho"), -place))
    return (rhos.where("abs(rho) > 0 and not isnan(rho)").agg(best.alias("_b")).where("_b is not null")
            .select("_b.metric", "_b.rho", "_b.n", (F.abs("_b.rho") > usable_above).alias("usable")))


def linear_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Degree-1 least squares ``y ~ x``."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(F.round(F.regr_slope(y, x), ROUND).alias("slope"),
                 F.round(F.regr_intercept(y, x), ROUND).alias("intercept"),
                 F.count(F.lit(1)).alias("n"))


def box_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, mean and 1.5 IQR whiskers per group."""
    keys = list(keys)
    q = df.groupBy(*keys).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("_q"),
                              F.avg(value).alias("_mean"))
    q = q.select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"), "_mean")
    j = df.join(q, keys).withColumn("_iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - F.lit(1.5) * F.col("_iqr")
    hi_f = F.col("q3") + F.lit(1.5) * F.col("_iqr")
    g = j.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("_mean").alias("_mean"),
        F.min(F.when(F.col(value) >= lo_f, F.col(value))).alias("whisker_lo"),
        F.max(F.when(F.col(value) <= hi_f, F.col(value))).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"))
    return g.select(*keys, *[F.round(c, ROUND).alias(c) for c in ["q1", "median", "q3"]],
                    F.round("_mean", ROUND).alias("mean"), "whisker_lo", "whisker_hi", "n")
