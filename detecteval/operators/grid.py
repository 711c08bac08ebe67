"""Threshold-grid sweeps in O(rows + grid) (kernel D; K6, C2-C4, T1, V2).

A grid is ``linspace(lo, hi, n)`` evaluated as numpy does:
``g_i = i*step + lo`` with ``step = (hi-lo)/(n-1)`` and ``g_{n-1} = hi``.
Each score gets ``idx`` = the largest i with ``g_i <= score`` (-1 if none):
``floor`` gives a first guess that is corrected by one step against the
exact grid values, so ``score >= g_j`` holds exactly when ``idx >= j``.
Counts per ``(keys, idx)`` then give, by a suffix sum over at most ``n``
rows per key, the positives and negatives at or above every grid point --
no row is ever paired with the grid.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_step(lo: float, hi: float, n: int) -> float:
    return (hi - lo) / (n - 1)


def grid_value(i: Column, lo: float, hi: float, n: int) -> Column:
    step = grid_step(lo, hi, n)
    return F.when(i == n - 1, F.lit(float(hi))).otherwise(
        i.cast("double") * F.lit(step) + F.lit(float(lo)))


def grid_index(score: Column, lo: float, hi: float, n: int) -> Column:
    """Largest i in [0, n-1] with g_i <= score, or -1."""
    step = grid_step(lo, hi, n)
    c0 = F.least(F.greatest(F.floor((score - F.lit(lo)) / F.lit(step)), F.lit(-1)),
                 F.lit(n - 1)).cast("int")
    up = c0 + 1
    return (F.when((up <= n - 1) & (grid_value(up, lo, hi, n) <= score), up)
            .when((c0 >= 0) & (grid_value(c0, lo, hi, n) > score), c0 - 1)
            .otherwise(c0))


def grid_counts(agg: DataFrame, keys: Sequence[str], lo: float, hi: float, n: int,
                score: str = "score") -> DataFrame:
    """Per (keys, j): grid value ``threshold`` and ``tp``/``fp`` = positives /
    negatives with score >= g_j, plus group totals ``n_pos``/``n_neg``.

    ``agg`` is a score table (keys, score, pos, neg).
    """
    keys = list(keys)
    bins = (agg.withColumn("_i", grid_index(F.col(score), lo, hi, n))
            .groupBy(*keys, "_i").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")))
    tot = bins.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    grid = tot.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    j = grid.join(bins.withColumnRenamed("_i", "j"), keys + ["j"], "left")
    w = (Window.partitionBy(*keys).orderBy(F.col("j").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    return j.select(*keys, "j", grid_value(F.col("j"), lo, hi, n).alias("threshold"),
                    F.coalesce(F.sum(F.coalesce("_p", F.lit(0))).over(w), F.lit(0)).alias("tp"),
                    F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(w), F.lit(0)).alias("fp"),
                    "n_pos", "n_neg")


# ------------------------------------------------------------- SQL twins
def sql_grid_value(i: str, lo: float, hi: float, n: int) -> str:
    step = grid_step(lo, hi, n)
    return (f"(CASE WHEN {i} = {n - 1} THEN {float(hi)!r}::DOUBLE "
            f"ELSE CAST({i} AS DOUBLE) * {step!r}::DOUBLE + {float(lo)!r}::DOUBLE END)")


def sql_grid_counts(name: str, agg: str, keys: Sequence[str], lo: float, hi: float,
                    n: int) -> str:
    """Straightforward SQL: every grid point against every distinct score."""
    kk = ", ".join(keys)
    on = " AND ".join(f"a.{c} = g.{c}" for c in keys)
    return f"""
{name}_g AS (SELECT {kk}, CAST(j AS INTEGER) AS j, {sql_grid_value('j', lo, hi, n)} AS threshold,
              n_pos, n_neg
            FROM (SELECT {kk}, SUM(pos) AS n_pos, SUM(neg) AS n_neg FROM {agg} GROUP BY {kk}) t
            CROSS JOIN range(0, {n}) r(j)),
{name} AS (SELECT {', '.join('g.' + c for c in keys)}, g.j, g.threshold,
            CAST(coalesce(SUM(CASE WHEN a.score >= g.threshold THEN a.pos END), 0) AS BIGINT) AS tp,
            CAST(coalesce(SUM(CASE WHEN a.score >= g.threshold THEN a.neg END), 0) AS BIGINT) AS fp,
            CAST(g.n_pos AS BIGINT) AS n_pos, CAST(g.n_neg AS BIGINT) AS n_neg
           FROM {name}_g g JOIN {agg} a ON {on}
           GROUP BY {', '.join('g.' + c for c in keys)}, g.j, g.threshold, g.n_pos, g.n_neg)"""
