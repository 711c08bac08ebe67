"""Label-free divergence between source and target score samples (V1-V7, K9).

Input is a PT with a two-valued ``side`` column (``val`` = source,
``test`` = target). Every statistic is one keyed aggregation; floating sums
are rounded to 9 digits.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import binary_entropy
from .grid import grid_index, grid_value

ROUND = 9
N_BINS = 50
SRC, TGT = "val", "test"


def _bin_widths(n_bins: int):
    # np.histogram(density=True) divides by the float differences of the
    # linspace edges, which are not all equal.
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    return [edges[i + 1] - edges[i] for i in range(n_bins)]


def histogram_probs(pt: DataFrame, keys: Sequence[str], n_bins: int = N_BINS,
                    score: str = "score") -> DataFrame:
    """Per (keys, side, bin): density histogram on [0, 1] (last bin closed)
    plus 1e-10, renormalised to sum 1; empty bins included (V2, K9)."""
    keys = list(keys)
    ks = keys + ["side"]
    idx = F.least(grid_index(F.col(score), 0.0, 1.0, n_bins + 1), F.lit(n_bins - 1))
    cnt = pt.withColumn("bin", idx).groupBy(*ks, "bin").agg(F.count(F.lit(1)).alias("_c"))
    tot = cnt.groupBy(*ks).agg(F.sum("_c").alias("_n"))
    full = tot.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    j = full.join(cnt, ks + ["bin"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    widths = F.array(*[F.lit(w) for w in _bin_widths(n_bins)])
    dens = (F.col("_c").cast("double") / (F.col("_n").cast("double") * F.element_at(widths, F.col("bin") + 1))
            + F.lit(1e-10))
    j = j.withColumn("_d", dens)
    w = Window.partitionBy(*ks)
    return j.select(*ks, "bin", (F.col("_d") / F.sum("_d").over(w)).alias("p"))


def ks_statistic(pt: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Two-sample KS statistic max|F_src - F_tgt| (V4): one aggregation per
    (keys, score) with counts per side, then running sums."""
    from .curves import descending_running_sums
    keys = list(keys)
    agg = pt.groupBy(*keys, score).agg(
        F.sum(F.when(F.col("side") == SRC, 1).otherwise(0)).alias("cs"),
        F.sum(F.when(F.col("side") == TGT, 1).otherwise(0)).alias("ct"))
    cur = descending_running_sums(agg, keys, score, ["cs", "ct"])
    # count(<= x) = total - count(>= x) + count(= x)
    fs = (F.col("tot_cs") - F.col("cum_cs") + F.col("cs")).cast("double") / F.col("tot_cs").cast("double")
    ft = (F.col("tot_ct") - F.col("cum_ct") + F.col("ct")).cast("double") / F.col("tot_ct").cast("double")
    return cur.groupBy(*keys).agg(F.max(F.abs(fs - ft)).alias("ks_statistic"))


def divergence(pt: DataFrame, keys: Sequence[str], score: str = "score",
               n_bins: int = N_BINS) -> DataFrame:
    """All six drift statistics per group (V1-V7)."""
    keys = list(keys)
    ks = keys + ["side"]
    mom = pt.groupBy(*ks).agg(
        F.avg(score).alias("_mean"),
        F.avg(binary_entropy(F.col(score))).alias("_ent"),
        F.avg((F.col(score) >= 0.5).cast("double")).alias("_ppr"))
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    m = mom.groupBy(*keys).agg(
        F.round(F.abs(side("_mean", TGT) - side("_mean", SRC)), ROUND).alias("mean_shift"),
        F.round(F.abs(side("_ent", TGT) - side("_ent", SRC)), ROUND).alias("entropy_diff"),
        F.abs(side("_ppr", TGT) - side("_ppr", SRC)).alias("ppr_diff"))
    h = histogram_probs(pt, keys, n_bins, score)
    hw = h.groupBy(*keys, "bin").agg(side("p", SRC).alias("ps"), side("p", TGT).alias("pt"))
    mid = F.lit(0.5) * (F.col("ps") + F.col("pt"))
    kl = hw.groupBy(*keys).agg(
        F.round(F.sum(F.col("pt") * F.ln(F.col("pt") / F.col("ps"))), ROUND).alias("kl_divergence"),
        F.round(F.lit(0.5) * F.sum(F.col("ps") * F.ln(F.col("ps") / mid))
                + F.lit(0.5) * F.sum(F.col("pt") * F.ln(F.col("pt") / mid)), ROUND)
        .alias("js_divergence"))
    return m.join(kl, keys).join(ks_statistic(pt, keys, score), keys)
