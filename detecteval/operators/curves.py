"""Precision-recall curves, thresholds and confusion metrics.

A prediction table (PT) has ``keys..., label INT, score DOUBLE``. Every
function takes ``keys`` so one call serves one model or thousands of
(model, seed, fold, side[, project]) groups at once.

Curve kernel (kernel B): rows are first aggregated to one row per
``(keys, score)`` -- a map-side partial aggregation, so a group holding a
third of all rows still spreads over all reducers by score. Inclusive
running sums in descending score order are then computed per score bucket:
bucket edges are per-key approximate quantiles of the distinct scores,
bucket totals get a running offset over ``n_buckets`` rows per key, and
the window runs partitioned by ``(keys, bucket)``. Equal scores always share
a bucket, so ties are exact; the result does not depend on the edges.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import f1_counts, safe_div
from ..session import checkpoint

EPS_F1 = 1e-12
#: Distinct scores of one key that a task sums; larger keys are cut into as many
#: buckets as it takes, so a task's rows do not grow with the data.
BUCKET_ROWS = 250_000
BROADCAST_CELLS = 1 << 18  # bucket edges and totals sent to every task at most


def score_table(pt: DataFrame, keys: Sequence[str], score: str = "score",
                label: str = "label") -> DataFrame:
    """One row per (keys, score): ``pos``, ``neg`` (A6 input)."""
    return (pt.groupBy(*keys, score)
            .agg(F.sum(F.col(label)).cast("long").alias("pos"),
                 F.count(F.lit(1)).alias("_cnt"))
            .withColumn("neg", F.col("_cnt") - F.col("pos")).drop("_cnt"))


def descending_running_sums(agg: DataFrame, keys: Sequence[str], order_col: str,
                            value_cols: Sequence[str], n_buckets: int = 1,
                            prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``value_cols`` over descending ``order_col``
    within ``keys`` (kernel B), plus per-key totals ``tot_<v>``.

    ``agg`` must hold one row per (keys, order_col).
    """
    keys = list(keys)
    vals = list(value_cols)
    desc = Window.unboundedPreceding
    if n_buckets <= 1:
        w = (Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
             .rowsBetween(desc, 0))
        wt = Window.partitionBy(*keys)
        return agg.select("*", *[F.sum(v).over(w).alias(prefix + v) for v in vals],
                          *[F.sum(v).over(wt).alias("tot_" + v) for v in vals])
    probs = [i / n_buckets for i in range(1, n_buckets)]
    if not keys:
        raise ValueError("keys must not be empty; add a constant key column")
    edges = checkpoint(agg.groupBy(*keys).agg(
        F.percentile_approx(order_col, probs, max(1000, 10 * n_buckets)).alias("_edges")))
    # A join that shuffles by key leaves every bucket of a key in one task. Few keys:
    # both bounded tables go to the rows, and the window below deals the buckets out.
    near = F.broadcast if edges.count() * n_buckets <= BROADCAST_CELLS else (lambda t: t)
    b = agg.join(near(edges), keys)
    b = b.withColumn("_bk", F.size(F.filter("_edges", lambda e: e < F.col(order_col)))) \
         .drop("_edges")
    tot = b.groupBy(*keys, "_bk").agg(*[F.sum(v).alias("_t_" + v) for v in vals])
    wb = Window.partitionBy(*keys).orderBy(F.col("_bk").desc()).rowsBetween(desc, -1)
    wk = Window.partitionBy(*keys)
    off = tot.select(*keys, "_bk",
                     *[F.coalesce(F.sum("_t_" + v).over(wb), F.lit(0)).alias("_o_" + v)
                       for v in vals],
                     *[F.sum("_t_" + v).over(wk).alias("tot_" + v) for v in vals])
    wr = (Window.partitionBy(*keys, "_bk").orderBy(F.col(order_col).desc())
          .rowsBetween(desc, 0))
    j = b.join(near(off), keys + ["_bk"])
    return j.select(*agg.columns,
                    *[(F.col("_o_" + v) + F.sum(v).over(wr)).alias(prefix + v) for v in vals],
                    *["tot_" + v for v in vals])


def materialised_score_table(pt: DataFrame, keys: Sequence[str], score: str = "score",
                             label: str = "label") -> DataFrame:
    """Score table written once to the checkpoint folder: every consumer
    (edges, bucket totals, windows, confusion joins) then reads the reduced
    table instead of rescanning and rehashing the raw rows."""
    return checkpoint(score_table(pt, keys, score, label))


def choose_buckets(agg: DataFrame, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets that hold about ``bucket_rows`` distinct scores of the largest
    key (1 is a plain window); one small job over the score table."""
    mx = agg.groupBy(*keys).count().agg(F.max("count")).collect()[0][0] or 0
    return max(1, -(-mx // bucket_rows))


def pr_curve(pt: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label",
             n_buckets: int | None = None, agg: DataFrame | None = None) -> DataFrame:
    """Per distinct score: ``pos, neg, tp, fp, n_pos, n_neg, precision, recall, f1``
    with tp/fp = positives/negatives scored >= score (A6).

    ``recall`` is 1 when a group has no positives (as sklearn does) and
    ``f1 = 2pr/(p+r+1e-12)`` is the curve F1 used for threshold choice.
    ``n_buckets=None`` picks the plan from the score table's key sizes.
    """
    if agg is None:
        agg = materialised_score_table(pt, keys, score, label)
    if n_buckets is None:
        n_buckets = choose_buckets(agg, keys)
    cur = descending_running_sums(agg, keys, score, ["pos", "neg"], n_buckets)
    cur = cur.select(*keys, score, "pos", "neg",
                     F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                     F.col("tot_pos").alias("n_pos"), F.col("tot_neg").alias("n_neg"))
    p = F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    r = F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(
        F.col("tp").cast("double") / F.col("n_pos").cast("double"))
    cur = cur.withColumn("precision", p).withColumn("recall", r)
    return cur.withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall")
                          / (F.col("precision") + F.col("recall") + F.lit(EPS_F1)))


def threshold_max_f1(curve: DataFrame, keys: Sequence[str], score: str = "score",
                     name: str = "threshold") -> DataFrame:
    """Score of maximum curve F1, lowest score on ties.

    Groups absent from the PT get no row; callers coalesce to 0.5.
    """
    return curve.groupBy(*keys).agg(
        F.max_by(F.col(score), F.struct(F.col("f1"), -F.col(score))).alias(name))


def threshold_at_precision(curve: DataFrame, keys: Sequence[str], min_precision: float,
                           score: str = "score", name: str = "threshold") -> DataFrame:
    """Lowest score with precision >= p, else 1.0."""
    return curve.groupBy(*keys).agg(F.coalesce(
        F.min(F.when(F.col("precision") >= F.lit(min_precision), F.col(score))),
        F.lit(1.0)).alias(name))


def curve_summary(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average precision and ROC AUC per group, NULL if one class (A2, A3).

    AUC's numerator is summed as DECIMAL(38,0): exact and order independent
    at any scale; AP is a floating sum of per-score terms.
    """
    term_auc = (F.col("pos").cast("decimal(38,0)")
                * (F.lit(2) * (F.col("n_neg") - F.col("fp")) + F.col("neg")).cast("decimal(38,0)"))
    g = curve.groupBy(*keys).agg(
        F.sum(F.col("pos").cast("double") * F.col("precision")).alias("_ap"),
        F.sum(term_auc).alias("_auc"),
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    one_class = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    return g.select(
        *keys,
        F.when(one_class, F.lit(None).cast("double"))
        .otherwise(F.col("_ap") / F.col("n_pos").cast("double")).alias("pr_auc"),
        F.when(one_class, F.lit(None).cast("double"))
        .otherwise(F.col("_auc").cast("double")
                   / (F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
        .alias("roc_auc"))


def confusion_at(agg: DataFrame, thresholds: DataFrame, keys: Sequence[str],
                 score: str = "score", thr: str = "threshold") -> DataFrame:
    """Confusion counts at one threshold per group.

    ``agg`` is a score table (``score_table``) and ``thresholds`` has
    ``join keys + [thr]`` plus optional extra key columns (e.g. ``kind``);
    the join is on the columns the two share.
    """
    on = [c for c in thresholds.columns if c in agg.columns and c != score]
    extra = [c for c in thresholds.columns if c not in on and c != thr]
    j = agg.join(thresholds, on)
    hit = F.col(score) >= F.col(thr)
    g = j.groupBy(*on, *extra).agg(
        F.first(thr).alias(thr),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"))
    return g


def metrics_from_confusion(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 on zero division), rates, collapse flag (A1, A4)."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = (conf.withColumn("precision", safe_div("tp", F.col("tp") + F.col("fp")))
           .withColumn("recall", safe_div("tp", F.col("tp") + F.col("fn")))
           .withColumn("f1", f1_counts("tp", "fp", "fn"))
           .withColumn("pred_pos_rate", safe_div(F.col("tp") + F.col("fp"), n))
           .withColumn("base_pos_rate", safe_div(F.col("tp") + F.col("fn"), n)))
    return out.withColumn("collapsed", (F.col("pred_pos_rate") < 1e-3)
                          | (F.col("pred_pos_rate") > 1 - 1e-3))


def compute_metrics(pt: DataFrame, keys: Sequence[str], threshold: float = 0.5,
                    score: str = "score", label: str = "label",
                    n_buckets: int | None = None) -> DataFrame:
    """Full metric row per group at a fixed threshold, with AP and AUC (A1-A4)."""
    keys = list(keys)
    if not keys:
        return compute_metrics(pt.withColumn("_one", F.lit(1)), ["_one"], threshold,
                               score, label, n_buckets).drop("_one")
    agg = materialised_score_table(pt, keys, score, label)
    thr = agg.select(*keys).distinct().withColumn("threshold", F.lit(float(threshold)))
    m = metrics_from_confusion(confusion_at(agg, thr, keys, score))
    cur = pr_curve(pt, keys, score, label, n_buckets, agg=agg)
    return m.join(curve_summary(cur, keys), keys, "left")


def metrics_at(pt: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str = "score",
               label: str = "label") -> DataFrame:
    """Metric rows at each row of ``thresholds`` (``keys``, threshold and extra
    columns such as a kind), with AP and AUC of the key (A1-A4)."""
    agg = materialised_score_table(pt, keys, score, label)
    m = metrics_from_confusion(confusion_at(agg, thresholds, keys, score))
    return m.join(curve_summary(pr_curve(pt, keys, score, label, agg=agg), keys), list(keys), "left")


def protocol_metrics(pt: DataFrame, keys: Sequence[str], test: DataFrame | None = None) -> DataFrame:
    """Test metrics at 0.5 and at the threshold of largest F1 on the validation side
    (0.5 without one). ``pt`` has a ``side``; ``test`` replaces its test rows."""
    keys = list(keys)
    test = pt.where("side = 'test'") if test is None else test
    best = threshold_max_f1(pr_curve(pt.where("side = 'val'"), keys), keys, name="_best")
    kinds = (test.select(*keys).distinct().join(best, keys, "left")
             .withColumn("_t", F.explode(F.array(
                 F.struct(F.lit("fixed_05").alias("thr_kind"), F.lit(0.5).alias("threshold")),
                 F.struct(F.lit("calibrated").alias("thr_kind"), F.coalesce("_best", F.lit(0.5)).alias("threshold")))))
             .select(*keys, "_t.thr_kind", "_t.threshold"))
    return metrics_at(test, checkpoint(kinds), keys)
