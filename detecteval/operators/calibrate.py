"""Label-free and few-label threshold adaptation."""
from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .grid import grid_counts, grid_step


def ppr_threshold(agg: DataFrame, keys: Sequence[str], target: float = 0.057,
                  lo: float = 0.01, hi: float = 0.99, n: int = 1000) -> DataFrame:
    """Grid threshold whose predicted-positive rate is closest to ``target``;
    first point wins ties; 0.5 if no point beats a difference of 1 (T1)."""
    g = grid_counts(agg, keys, lo, hi, n)
    ppr = (F.col("tp") + F.col("fp")).cast("double") / (F.col("n_pos") + F.col("n_neg")).cast("double")
    g = g.withColumn("_d", F.abs(ppr - F.lit(float(target))))
    r = g.groupBy(*keys).agg(F.min_by("threshold", F.struct("_d", "j")).alias("_t"),
                             F.min("_d").alias("_dmin"))
    return r.select(*keys, F.when(F.col("_dmin") < 1.0, F.col("_t")).otherwise(F.lit(0.5))
                    .alias("thr_ppr"))


def density_valley_threshold(pt: DataFrame, keys: Sequence[str], score: str = "score",
                             bw: float = 0.05, lo: float = 0.01, hi: float = 0.99,
                             n: int = 1000, inner_lo: float = 0.05, inner_hi: float = 0.95,
                             digits: int = 4, agg: DataFrame | None = None) -> DataFrame:
    """Minimum of a Gaussian KDE (bandwidth ``bw * stddev_samp``) on the grid,
    restricted to (inner_lo, inner_hi); 0.5 when degenerate (T2, D9).

    Scores are rounded to ``digits`` decimals at every size, so the histogram of a key
    has at most 10^digits + 1 cells. One task takes a key's histogram and sums the
    kernel over it for all grid points; no row is paired with the grid. The standard
    deviation is that of the scores as given, from the score table ``agg`` (keys,
    score, pos, neg) where the caller has one.
    """
    keys = list(keys)
    per_score = (agg.select(*keys, F.col(score), (F.col("pos") + F.col("neg")).alias("_c"))
                 if agg is not None else
                 pt.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c")))
    off = F.col(score) - F.lit(0.5)  # moments about the middle of the scores' range
    hist = per_score.groupBy(*keys, F.round(F.col(score), digits).alias("_s")).agg(
        F.sum("_c").alias("_c"), F.sum(F.col("_c") * off).alias("_m1"), F.sum(F.col("_c") * off * off).alias("_m2"))
    grid = np.arange(n) * grid_step(lo, hi, n) + lo
    grid[-1] = hi
    grid = grid[(grid > inner_lo) & (grid < inner_hi)]
    kinds = {f.name: f.dataType.simpleString() for f in hist.schema}

    def valley(pdf):
        pdf = pdf.sort_values("_s")
        c, s = pdf["_c"].to_numpy(np.float64), pdf["_s"].to_numpy(np.float64)
        rows, m1, m2 = c.sum(), pdf["_m1"].sum(), pdf["_m2"].sum()
        var = (m2 - m1 * m1 / rows) / (rows - 1) if rows >= 2 else 0.0
        best = 0.5
        if var > 1e-15 and len(grid):
            z = 1 / (bw * np.sqrt(var))
            density = [float((c * np.exp(-0.5 * ((x - s) * z) ** 2)).sum()) for x in grid]
            best = float(grid[int(np.argmin(density))])
        return pd.DataFrame([[*pdf[keys].iloc[0], best]], columns=[*keys, "thr_valley"])

    return hist.groupBy(*keys).applyInPandas(valley, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", thr_valley double")


def fit_temperature(cal: DataFrame, keys: Sequence[str], label: str = "label",
                    margin: str = "margin", lo: float = 0.1, hi: float = 10.0,
                    sections: int = 32, rounds: int = 6, digits: int = 6) -> DataFrame:
    """Temperature T in [lo, hi] of least NLL of ``sigmoid(margin / T)`` on the labelled
    calibration rows, per group (T3), rounded to ``digits``.

    The NLL is convex in 1/T, so its derivative ``sum((sigmoid(margin/T) - y) * margin)``
    falls through zero once as T grows. Each round is one aggregation that gives the
    derivative at ``sections`` points between the group's bounds; the bounds close in on
    the change of sign by ``sections + 1`` times. Without a change of sign T is the bound
    that the NLL falls towards; with margins of 0 only, the lower one.
    """
    keys = list(keys)
    cal = checkpoint(cal.select(*keys, F.col(margin).alias("_m"), F.col(label).cast("double").alias("_y")))
    bounds = cal.select(*keys).distinct().withColumn("_lo", F.lit(math.log(lo))).withColumn("_hi", F.lit(math.log(hi)))
    for _ in range(rounds):
        at = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(i / (sections + 1)) for i in range(1, sections + 1)]
        slope = [F.sum((F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m") * F.exp(-x))) - F.col("_y")) * F.col("_m")) for x in at]
        above = sum(((g > 0).cast("int") for g in slope), F.lit(0))
        step = (F.col("_hi") - F.col("_lo")) / F.lit(sections + 1)
        bounds = checkpoint(cal.join(bounds, keys).groupBy(*keys, "_lo", "_hi").agg(above.alias("_k"))
                            .select(*keys, (F.col("_lo") + step * F.col("_k")).alias("_lo"),
                                    (F.col("_lo") + step * (F.col("_k") + 1)).alias("_hi")))
    return bounds.select(*keys, F.round(F.exp((F.col("_lo") + F.col("_hi")) / 2), digits).alias("T"))


def apply_temperature(df: DataFrame, temps: DataFrame, keys: Sequence[str],
                      margin: str = "margin", name: str = "score_scaled", carry: Sequence[str] = ()) -> DataFrame:
    """``sigmoid(margin / T)`` = softmax of logits / T (P8). ``carry``: other columns of
    ``temps`` that go with each row."""
    return df.join(temps.select(*keys, *carry, "T"), keys).withColumn(
        name, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(margin) / F.col("T"))))
