"""Nested result documents: write and flatten."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nest_runs(runs: DataFrame, by: Sequence[str] = ("model",), summary: DataFrame | None = None,
              order: Sequence[str] = ("seed", "fold")) -> DataFrame:
    """One document per group: ``runs ARRAY<STRUCT>`` (sorted by ``order``)
    and an optional summary struct. Groups are per model: bounded arrays."""
    by = list(by)
    cols = [c for c in runs.columns if c not in by]
    ordered = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in cols]).alias("r"))
    g = runs.groupBy(*by).agg(F.sort_array(F.collect_list(ordered)).alias("_a"))
    g = g.select(*by, F.transform("_a", lambda x: x["r"]).alias("runs"))
    if summary is not None:
        s = summary.select(*by, F.struct(*[c for c in summary.columns if c not in by]).alias("summary"))
        g = g.join(s, by, "left")
    return g


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def flatten_runs(spark: SparkSession, path: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """Read nested JSON documents and flatten runs to one row each."""
    raw = spark.read.json(path)
    ex = raw.select(*by, F.explode("runs").alias("r"))
    return ex.select(*by, "r.*")


def methods_long(df: DataFrame, keys: Sequence[str], methods: Sequence[str], field: str = "f1") -> DataFrame:
    """Method struct columns -> (keys, method, value) via ``stack``."""
    cols = [F.col(f"{m}.{field}").alias(m) for m in methods]
    return df.select(*keys, *cols).unpivot(list(keys), list(methods), "method", field)
