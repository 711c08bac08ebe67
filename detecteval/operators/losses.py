"""Logit diagnostics and losses as aggregations."""
from __future__ import annotations

from typing import Callable, Dict, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 9


def logit_diagnostics(pt: DataFrame, keys: Sequence[str], logit0: str = "logit0",
                      logit1: str = "logit1") -> DataFrame:
    """Means, margin mean / population std, constant flag (std < 1e-3) and
    the strict share of positive margins (A9)."""
    m = F.col(logit1) - F.col(logit0)
    g = pt.groupBy(*keys).agg(
        F.round(F.avg(logit1), ROUND).alias("logit_pos_mean"),
        F.round(F.avg(logit0), ROUND).alias("logit_neg_mean"),
        F.round(F.avg(m), ROUND).alias("margin_mean"),
        F.stddev_pop(m).alias("_std"),
        F.avg((m > 0).cast("double")).alias("frac_predicts_pos"))
    return g.select(*keys, "logit_pos_mean", "logit_neg_mean", "margin_mean",
                    F.round("_std", ROUND).alias("margin_std"),
                    (F.col("_std") < 1e-3).alias("is_constant"), "frac_predicts_pos")


def _nll(label: str, l0: str, l1: str) -> Column:
    m = F.greatest(F.col(l0), F.col(l1))
    lse = m + F.ln(F.exp(F.col(l0) - m) + F.exp(F.col(l1) - m))
    return lse - F.when(F.col(label) == 1, F.col(l1)).otherwise(F.col(l0))


def weighted_ce(w0: float = 1.0, w1: float = 30.0) -> Callable[[str, str, str], Column]:
    """Class-weighted cross-entropy: sum(w*nll)/sum(w)."""
    def agg(label: str, l0: str, l1: str) -> Column:
        w = F.when(F.col(label) == 1, F.lit(float(w1))).otherwise(F.lit(float(w0)))
        return F.sum(w * _nll(label, l0, l1)) / F.sum(w)
    return agg


def focal(gamma: float = 2.0, alpha: float = 0.95) -> Callable[[str, str, str], Column]:
    """Focal loss, plain mean."""
    def agg(label: str, l0: str, l1: str) -> Column:
        nll = _nll(label, l0, l1)
        w = F.when(F.col(label) == 1, F.lit(float(alpha))).otherwise(F.lit(1 - alpha))
        py = F.exp(-nll)
        return F.avg(-w * F.pow(F.lit(1.0) - py, F.lit(float(gamma))) * (-nll))
    return agg


def build_loss(kind: str = "weighted_ce", **kw) -> Callable[[str, str, str], Column]:
    """Loss selection by name; ``ce`` is weights (1, 1)."""
    kind = kind.lower()
    reg: Dict[str, Callable[[], Callable]] = {
        "weighted_ce": lambda: weighted_ce(kw.get("w0", 1.0), kw.get("w1", 30.0)),
        "wce": lambda: weighted_ce(kw.get("w0", 1.0), kw.get("w1", 30.0)),
        "focal": lambda: focal(kw.get("gamma", 2.0), kw.get("alpha", 0.95)),
        "ce": lambda: weighted_ce(1.0, 1.0),
        "standard": lambda: weighted_ce(1.0, 1.0),
    }
    if kind not in reg:
        raise ValueError(f"Unknown loss '{kind}'")
    return reg[kind]()


def loss_table(pt: DataFrame, keys: Sequence[str], kinds: Sequence[str],
               label: str = "label", logit0: str = "logit0", logit1: str = "logit1") -> DataFrame:
    """One row per (keys, loss) with the loss value, all in one aggregation."""
    aggs = [F.round(build_loss(k)(label, logit0, logit1), ROUND).alias(k) for k in kinds]
    wide = pt.groupBy(*keys).agg(*aggs)
    return wide.unpivot(list(keys), list(kinds), "loss", "value")
