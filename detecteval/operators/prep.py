"""Corpus preparation: whitespace dedup and line-count filter."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedup_key, n_lines
from ..session import checkpoint


def dedup_first(df: DataFrame, text_col: str = "func", order_col: str = "row_id") -> DataFrame:
    """Exact dedup on the whitespace-normalised text, keep the smallest
    ``order_col`` (P1, P2).

    One aggregation (planned by sorting, since rows are carried) with map-side partial ``min_by``: a text repeated
    by a third of all rows collapses to one row per map task before the
    shuffle, so the hot key does not concentrate in one reducer.
    """
    cols = df.columns
    packed = (df.withColumn("_k", dedup_key(F.col(text_col)))
              .groupBy("_k")
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r")))
    return packed.select(*[F.col("_r." + c).alias(c) for c in cols])


def line_filter(df: DataFrame, min_lines: int = 5, max_lines: int = 500,
                text_col: str = "func") -> DataFrame:
    """Inclusive line-count range filter."""
    return df.filter(n_lines(F.col(text_col)).between(min_lines, max_lines))


def preprocess(df: DataFrame, min_lines: int = 5, max_lines: int = 500,
               drop_duplicates: bool = True) -> DataFrame:
    """Dedup (optional) then the length filter, in that order."""
    if drop_duplicates:
        df = dedup_first(df)
    return line_filter(df, min_lines, max_lines)


def first_n_of_class(df: DataFrame, label: int, n: int, order_col: str = "row_id") -> DataFrame:
    """First ``n`` rows of one class by ``row_id`` (P12): a top-k, so the
    limit is the feature; Spark plans it as TakeOrderedAndProject."""
    return df.filter(F.col("label") == label).orderBy(order_col).limit(n)


def ordinal_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """``name``: position of the row's value among the sorted distinct values,
    from 0 (P11). Values are range-partitioned, numbered within partitions and
    shifted by the sizes of the partitions before; null has no code."""
    values = checkpoint(df.where(F.col(col).isNotNull()).select(col).distinct().repartitionByRange(col)
                        .withColumn("_p", F.spark_partition_id()))
    shift = values.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.expr("coalesce(sum(_n) over (order by _p rows between unbounded preceding and 1 preceding), 0)"))
    codes = values.withColumn("_i", F.expr(f"row_number() over (partition by _p order by `{col}`) - 1"))
    codes = codes.join(shift, "_p").select(col, (F.col("_before") + F.col("_i")).cast("long").alias(name))
    return df.join(codes, col, "left")
