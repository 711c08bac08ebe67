"""Counterfactuals, occlusion and integrated gradients as table jobs.

For a TF-IDF + logistic model every attribution has a closed form over the
``(row, term)`` table, so no per-token rescoring blow-up happens: masking one
occurrence of term t changes only u_t and the row norm.
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import n_lines
from .models import IDX, RowTerms, TfidfModel, _tokens, by_term, coefficients, linear_score, numbers, per_row

# Sink calls neutralised by the counterfactual.
SINKS = ["strcpy", "gets", "sprintf", "memcpy", "strcat", "scanf"]


def counterfactual_sink_removal(df: DataFrame, scorer, sinks: Sequence[str] = SINKS,
                                mode: str = "substring", text_col: str = "func",
                                id_col: str = "row_id") -> DataFrame:
    """For every sink found in a row, replace it by ``/*sink*/safe_noop``,
    rescore, and report p_before, p_after, delta and the flip
    ``p_before >= .5 > p_after`` (E3, D12). ``scorer(df, text_col, name)``
    scores a frame; the exploded table is scored in one pass."""
    arr = F.array(*[F.lit(s) for s in sinks])
    if mode == "substring":
        found = F.filter(arr, lambda s: F.instr(F.col(text_col), s) > 0)
    else:
        found = F.filter(arr, lambda s: F.col(text_col).rlike(F.concat(F.lit("\\b"), s, F.lit("\\b"))))
    base = scorer(df, text_col, "p_before")
    ex = base.withColumn("sink", F.explode(found))
    cf_text = F.replace(F.col(text_col), F.col("sink"),
                        F.concat(F.lit("/*"), F.col("sink"), F.lit("*/safe_noop")))
    ex = ex.withColumn("_cf_key", F.concat_ws("#", F.col(id_col).cast("string"), F.col("sink"))) \
        .withColumn("_cf", cf_text)
    scored = scorer(ex.select("_cf_key", F.col("_cf").alias(text_col)).withColumnRenamed("_cf_key", id_col),
                    text_col, "p_after").select(F.col(id_col).alias("_cf_key"), "p_after")
    out = ex.join(scored, "_cf_key").drop("_cf", "_cf_key")
    return out.withColumn("delta", F.col("p_before") - F.col("p_after")) \
        .withColumn("flipped", (F.col("p_before") >= 0.5) & (F.col("p_after") < 0.5))


def flip_rates(cf: DataFrame, all_rows: DataFrame, keys: Sequence[str] = (),
               id_col: str = "row_id") -> DataFrame:
    """(a) any-flip rows / all rows, (b) any-flip rows / rows with a sink,
    sinks found, max delta (E4)."""
    keys = list(keys)
    per = cf.groupBy(*keys, id_col).agg(F.max(F.col("flipped").cast("int")).alias("_f"),
                                        F.max("delta").alias("_md"),
                                        F.count(F.lit(1)).alias("_ns"))
    g = (per.groupBy(*keys) if keys else per.groupBy()).agg(
        F.count(F.lit(1)).alias("n_with_sink"), F.sum("_f").alias("n_flipped"),
        F.sum("_ns").alias("sinks_found"), F.max("_md").alias("max_delta"))
    n_all = (all_rows.groupBy(*keys) if keys else all_rows.groupBy()).agg(F.count(F.lit(1)).alias("n_tested"))
    j = g.join(n_all, keys) if keys else g.join(n_all)
    return j.select(*keys, "n_tested", "n_with_sink", F.coalesce("n_flipped", F.lit(0)).alias("n_flipped"),
                    "sinks_found", "max_delta",
                    (F.coalesce("n_flipped", F.lit(0)) / F.col("n_tested")).alias("flip_rate_all"),
                    F.when(F.col("n_with_sink") > 0, F.col("n_flipped") / F.col("n_with_sink"))
                    .alias("flip_rate_with_sink"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def occlusion_linear(tf: TfidfModel, weights: DataFrame, intercept: float, df: DataFrame,
                     text_col: str = "func", id_col: str = "row_id") -> DataFrame:
    """Importance of masking one occurrence of each term: p(full) - p(masked),
    exact for TF-IDF + logistic (E5). One row per (row, term)."""
    coef = coefficients(tf, weights)

    def run(t: RowTerms):
        t = t.only(~np.isnan(coef[t.idx]))
        c = coef[t.idx]
        n2, dot = t.total(t.u * t.u)[t.row], t.total(t.u * c)[t.row]
        u2 = np.where(t.tf > 1, (1.0 + np.log(np.maximum(t.tf - 1, 1))) * t.idf, 0.0)
        n2m = n2 - t.u * t.u + u2 * u2
        zm = np.where(n2m > 0, (dot - c * t.u + c * u2) / np.sqrt(np.where(n2m > 0, n2m, 1.0)), 0.0)
        delta = _sigmoid(intercept + dot / np.sqrt(n2)) - _sigmoid(intercept + zm)
        return t.lists(t.idx, pa.int32()), t.lists(t.tf, pa.float64()), t.lists(delta, pa.float64())
    arrays = per_row(tf, _tokens(df, text_col, id_col), [IDX, numbers("tf"), numbers("delta")], run)
    return by_term(tf, arrays, id_col, "tf", "delta").select(id_col, "term", F.col("tf").cast("long").alias("tf"), "delta")


def integrated_gradients_linear(tf: TfidfModel, weights: DataFrame, intercept: float,
                                df: DataFrame, text_col: str = "func",
                                id_col: str = "row_id") -> DataFrame:
    """Exact integrated gradients from the all-zero baseline for a logistic
    model on TF-IDF features: ``w_i x_i (s(z) - s(b)) / (z - b)``; the
    attributions of a row sum to ``s(z) - s(b)`` (E6)."""
    coef = coefficients(tf, weights)
    base = float(_sigmoid(np.float64(intercept)))

    def run(t: RowTerms):
        own = ~np.isnan(coef[t.idx])
        wx = (t.weight() * coef[t.idx])[own]
        t = t.only(own)
        z = intercept + t.total(wx)
        far = np.abs(z - intercept) > 1e-12
        gain = _sigmoid(z) - base
        ratio = np.where(far, gain / np.where(far, z - intercept, 1.0), base * (1.0 - base))
        return (t.lists(t.idx, pa.int32()), t.lists(wx * ratio[t.row], pa.float64()),
                t.lists(gain[t.row], pa.float64()))
    rows = _tokens(df, text_col, id_col).where(F.col(id_col).isNotNull())
    arrays = per_row(tf, rows, [IDX, numbers("attribution"), numbers("delta_prob")], run)
    return by_term(tf, arrays, id_col, "attribution", "delta_prob").drop("idx")


def top_k_by_abs(df: DataFrame, k: int = 10, value: str = "delta", id_col: str = "row_id",
                 tie: str = "term") -> DataFrame:
    """Top-k entries per row by |value| (W1): a top-k report."""
    w = Window.partitionBy(id_col).orderBy(F.abs(F.col(value)).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def make_linear_scorer(tf: TfidfModel, weights: DataFrame, intercept: float, id_col: str = "row_id"):
    def scorer(df: DataFrame, text_col: str, name: str) -> DataFrame:
        return linear_score(tf, weights, intercept, df, text_col, id_col, name)
    return scorer


def make_call_scorer(weights: dict, scale: float = 10.0, bias: float = -1.0):
    """A fixed scorer for checks: logistic of the weighted calls in a text
    (name, then an opening bracket) per line."""
    def scorer(df: DataFrame, text_col: str, name: str) -> DataFrame:
        z = F.lit(0.0)
        for call, weight in weights.items():
            n = F.regexp_count(F.col(text_col), F.lit(rf"\b{call}\("))
            z = z + F.lit(float(weight)) * n.cast("double")
        z = F.lit(bias) + F.lit(scale) * z / n_lines(F.col(text_col)).cast("double")
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return scorer
