"""Scalar column maths shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decision(score, threshold) -> Column:
    """``score >= t`` as 0/1 (P7), inclusive."""
    return (col(score) >= col(threshold) if not isinstance(threshold, (int, float))
            else col(score) >= F.lit(float(threshold))).cast("int")


def softmax_pos(logit0, logit1) -> Column:
    """P(class 1) of a two-class softmax, max-shifted."""
    l0, l1 = col(logit0), col(logit1)
    m = F.greatest(l0, l1)
    e0, e1 = F.exp(l0 - m), F.exp(l1 - m)
    return e1 / (e0 + e1)


def margin(logit0, logit1) -> Column:
    """``logit1 - logit0``."""
    return col(logit1) - col(logit0)


def clip(c, lo: float, hi: float) -> Column:
    """``np.clip`` (P10)."""
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def binary_entropy(p, eps: float = 1e-10) -> Column:
    """Entropy of a Bernoulli(p), p clipped to [eps, 1-eps] (V5)."""
    q = clip(p, eps, 1 - eps)
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def logit_from_score(score, eps: float = 0.0005) -> Column:
    """Fixture logit: ``ln((s+eps)/(1+eps-s))``."""
    s = col(score)
    return F.ln((s + F.lit(eps)) / (F.lit(1.0 + eps) - s))


def risk_zone(rate) -> Column:
    """<0.03 low, <0.08 medium, else high."""
    r = col(rate)
    return (F.when(r < 0.03, F.lit("low")).when(r < 0.08, F.lit("medium"))
            .otherwise(F.lit("high")))


def verdict(mean_gap) -> Column:
    """Verdict bands on the mean F1 gap."""
    g = col(mean_gap)
    return (F.when(g > 0.05, F.lit("viable")).when(g > 0.02, F.lit("borderline"))
            .otherwise(F.lit("dead")))


def safe_div(num, den, default: float = 0.0) -> Column:
    """num/den as double, ``default`` when den is 0 (sklearn zero_division)."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d == 0, F.lit(default)).otherwise(n / d)


def f1_counts(tp, fp, fn) -> Column:
    """F1 from confusion counts: 2tp/(2tp+fp+fn), 0 when undefined."""
    return safe_div(F.lit(2) * col(tp), F.lit(2) * col(tp) + col(fp) + col(fn))
