"""Decision-cost evaluation: expected cost, cost-optimal thresholds, cost
curves, budget recall and model ranking (C1-C6)."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import curves as cv
from .grid import grid_counts

# FN:FP cost ratios and review budgets of the cost study.
COST_RATIOS = [1, 5, 10, 25, 50, 100]
BUDGETS = [50, 100, 200, 500, 1000, 2000]


def expected_cost_expr(fn: Column, fp: Column, n: Column, fn_cost: Column,
                       fp_cost: float = 1.0) -> Column:
    """``(fn*c_fn + fp*c_fp) / n`` per row."""
    return ((fn * fn_cost).cast("double") + fp.cast("double") * F.lit(float(fp_cost))) \
        / n.cast("double")


def cost_grid(agg: DataFrame, keys: Sequence[str], ratios: Sequence[int] = COST_RATIOS,
              lo: float = 0.0, hi: float = 1.0, n: int = 500, fp_cost: float = 1.0) -> DataFrame:
    """Expected cost at every grid threshold and ratio (C4 when lo=.01,
    hi=.99, n=200). Ratios are a literal list: bounded expansion."""
    g = grid_counts(agg, keys, lo, hi, n)
    g = g.withColumn("fn_fp_ratio", F.explode(F.array(*[F.lit(int(r)) for r in ratios])))
    fn = F.col("n_pos") - F.col("tp")
    return g.withColumn("expected_cost", expected_cost_expr(
        fn, F.col("fp"), F.col("n_pos") + F.col("n_neg"), F.col("fn_fp_ratio"), fp_cost))


def optimal_cost_threshold(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First grid threshold of minimum expected cost per (keys, ratio)."""
    return grid.groupBy(*keys, "fn_fp_ratio").agg(
        F.min_by("threshold", F.struct("expected_cost", "j")).alias("optimal_threshold"),
        F.min("expected_cost").alias("min_expected_cost"))


def cost_table(test_agg: DataFrame, f1_thr: DataFrame, keys: Sequence[str],
               ratios: Sequence[int] = COST_RATIOS, n: int = 500) -> DataFrame:
    """Per (keys, ratio): optimal threshold, min cost, cost at the F1
    threshold, penalty %, recall/precision/F1 at the cost optimum and recall
    at the F1 threshold (C3). ``f1_thr`` has ``keys + [threshold]``."""
    keys = list(keys)
    opt = optimal_cost_threshold(cost_grid(test_agg, keys, ratios, 0.0, 1.0, n), keys)
    ths = (opt.select(*keys, "fn_fp_ratio", F.col("optimal_threshold").alias("threshold"))
           .withColumn("kind", F.lit("cost"))
           .unionByName(f1_thr.select(*keys, "threshold")
                        .withColumn("fn_fp_ratio", F.explode(F.array(*[F.lit(int(r)) for r in ratios])))
                        .withColumn("kind", F.lit("f1"))))
    m = cv.metrics_from_confusion(cv.confusion_at(test_agg, ths, keys))
    n_all = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    m = m.withColumn("_cost", expected_cost_expr(F.col("fn"), F.col("fp"), n_all,
                                                 F.col("fn_fp_ratio")))
    kk = keys + ["fn_fp_ratio"]
    wide = m.groupBy(*kk).agg(
        F.max(F.when(F.col("kind") == "f1", F.col("_cost"))).alias("cost_at_f1_threshold"),
        F.max(F.when(F.col("kind") == "f1", F.col("threshold"))).alias("f1_threshold"),
        F.max(F.when(F.col("kind") == "cost", F.col("recall"))).alias("recall_at_cost_optimal"),
        F.max(F.when(F.col("kind") == "cost", F.col("precision"))).alias("precision_at_cost_optimal"),
        F.max(F.when(F.col("kind") == "cost", F.col("f1"))).alias("f1_at_cost_optimal"),
        F.max(F.when(F.col("kind") == "f1", F.col("recall"))).alias("recall_at_f1_optimal"))
    out = opt.join(wide, kk)
    return out.withColumn("cost_penalty_pct", F.lit(100.0) * (
        F.col("cost_at_f1_threshold") - F.col("min_expected_cost"))
        / F.greatest(F.col("min_expected_cost"), F.lit(1e-9)))


def budget_recall(pt: DataFrame, keys: Sequence[str], budgets: Sequence[int] = BUDGETS,
                  score: str = "score", id_col: str = "row_id") -> DataFrame:
    """Share of positives among the top-K rows by (score desc, row_id) for
    every budget K; 0 when a group has no positives (C5).

    Counts come from the score table's running sums; only the one tie group
    that straddles position K is ranked row by row.
    """
    keys = list(keys)
    agg = cv.materialised_score_table(pt, keys, score)
    cur = cv.descending_running_sums(agg, keys, score, ["pos", "neg"], cv.choose_buckets(agg, keys))
    cur = cur.withColumn("_cnt", F.col("pos") + F.col("neg")) \
        .withColumn("_cum", F.col("cum_pos") + F.col("cum_neg")) \
        .withColumn("_n", F.col("tot_pos") + F.col("tot_neg"))
    b = cur.withColumn("budget", F.explode(F.array(*[F.lit(int(x)) for x in budgets])))
    b = b.withColumn("_k", F.least(F.col("budget").cast("long"), F.col("_n")))
    before = F.col("_cum") - F.col("_cnt")
    full = b.filter(F.col("_cum") <= F.col("_k")).groupBy(*keys, "budget").agg(
        F.sum("pos").alias("_found_full"))
    edge = b.filter((before < F.col("_k")) & (F.col("_cum") > F.col("_k"))) \
        .select(*keys, "budget", score, (F.col("_k") - before).alias("_need"))
    rows = pt.select(*keys, score, id_col, "label").join(edge, keys + [score])
    w = Window.partitionBy(*keys, "budget").orderBy(F.col(id_col))
    part = (rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_need"))
            .groupBy(*keys, "budget").agg(F.sum("label").alias("_found_edge")))
    groups = cur.groupBy(*keys).agg(F.first("tot_pos").alias("n_pos"))
    g = groups.withColumn("budget", F.explode(F.array(*[F.lit(int(x)) for x in budgets])))
    out = g.join(full, keys + ["budget"], "left").join(part, keys + ["budget"], "left")
    found = F.coalesce("_found_full", F.lit(0)) + F.coalesce("_found_edge", F.lit(0))
    return out.select(*keys, "budget", found.cast("long").alias("found"), "n_pos",
                      F.when(F.col("n_pos") == 0, F.lit(0.0))
                      .otherwise(found.cast("double") / F.col("n_pos").cast("double"))
                      .alias("budget_recall"))


def rank_models(table: DataFrame, by: str = "min_expected_cost", part: str = "fn_fp_ratio",
                model: str = "model") -> DataFrame:
    """Rank of each model per cost ratio, ties by model name."""
    w = Window.partitionBy(part).orderBy(F.col(by), F.col(model))
    return table.withColumn("rank", F.row_number().over(w))
