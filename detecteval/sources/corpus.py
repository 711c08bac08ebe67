"""Corpus sources and canonicalisation.

Every loader returns the unified record
``row_id LONG, func STRING, label INT, project STRING, cwe STRING``.
``row_id`` replaces pandas' implicit row order: "keep first" means the
smallest ``row_id``.
"""
from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_blocks import read_csv

REQUIRED_COLS = ["func", "label", "project", "cwe"]
UNIFIED_COLS = ["row_id"] + REQUIRED_COLS

# Column-name aliases of the raw corpora, in priority order.
CSV_CODE_ALIASES = ["func_before", "processed_func", "func", "code"]
CSV_LABEL_ALIASES = ["vul", "target", "label", "is_vul"]
CSV_PROJECT_ALIASES = ["project", "repo", "Project"]
CSV_CWE_ALIASES = ["CWE ID", "cwe", "CWE", "cwe_id"]
GROUP_FALLBACK_ALIASES = ["commit_id", "commit", "file_name", "hash"]
JSON_CODE_ALIASES = ["func", "code", "function"]
JSON_LABEL_ALIASES = ["target", "label", "vul"]
JSON_PROJECT_ALIASES = ["project", "repo"]


def first_present(df: DataFrame, candidates: Iterable[str]) -> Optional[str]:
    """First alias present in ``df.columns`` (S3); plan-time, no job."""
    cols = set(df.columns)
    for c in candidates:
        if c in cols:
            return c
    return None


def derive_project(df: DataFrame) -> Column:
    """Group key when no project column exists."""
    c = first_present(df, GROUP_FALLBACK_ALIASES)
    return F.col(f"`{c}`").cast("string") if c else F.lit("UNKNOWN")


def _label_int(c: Column) -> Column:
    # Through DOUBLE so "1.0" is accepted; a non-numeric label raises (ANSI).
    return c.cast("string").cast("double").cast("int")


def canonicalise(df: DataFrame) -> DataFrame:
    """Required-column check, casts, defaults, drop empty code.

    Null or empty ``func`` is dropped; null or empty ``project`` becomes
    ``UNKNOWN``; null ``cwe`` becomes ``''``.
    """
    missing = [c for c in REQUIRED_COLS if c not in df.columns]
    if missing:
        raise ValueError(f"frame is missing {missing}; got {df.columns}")
    rid = F.col("row_id").cast("long") if "row_id" in df.columns else _content_id(df)
    out = df.select(
        rid.alias("row_id"),
        F.col("func").cast("string").alias("func"),
        _label_int(F.col("label")).alias("label"),
        F.coalesce(F.nullif(F.col("project").cast("string"), F.lit("")), F.lit("UNKNOWN")).alias("project"),
        F.coalesce(F.col("cwe").cast("string"), F.lit("")).alias("cwe"),
    )
    return out.filter(F.col("func").isNotNull() & (F.length("func") > 0))


def _content_id(df: DataFrame) -> Column:
    """Hash of all columns: the same under any partitioning. Equal rows share it."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])


def _row_id_from_file(df: DataFrame) -> Column:
    """Hash of the file's name and the row's content."""
    return F.xxhash64(F.col("_metadata.file_name"), _content_id(df))


def load_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV corpus with drifting column names, multi-line quoted code (S1). Files are
    read in byte blocks by many tasks; ``row_id`` is the record's place."""
    raw = read_csv(spark, path)
    code = first_present(raw, CSV_CODE_ALIASES)
    label = first_present(raw, CSV_LABEL_ALIASES)
    if code is None or label is None:
        raise ValueError(f"no code/label column among {raw.columns}")
    proj = first_present(raw, CSV_PROJECT_ALIASES)
    cwe = first_present(raw, CSV_CWE_ALIASES)
    out = raw.select(
        F.col("_number").alias("row_id"),
        F.col(f"`{code}`").alias("func"),
        F.col(f"`{label}`").alias("label"),
        (F.col(f"`{proj}`") if proj else derive_project(raw)).alias("project"),
        (F.col(f"`{cwe}`") if cwe else F.lit("")).alias("cwe"),
    )
    return canonicalise(out)


def load_json_or_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of records, or CSV, chosen by file suffix."""
    if path.lower().endswith(".json"):
        raw = spark.read.option("multiLine", True).json(path)
    else:
        raw = read_csv(spark, path)
    code = first_present(raw, JSON_CODE_ALIASES)
    label = first_present(raw, JSON_LABEL_ALIASES)
    if code is None or label is None:
        raise ValueError(f"no code/label column among {raw.columns}")
    proj = first_present(raw, JSON_PROJECT_ALIASES)
    out = raw.select(
        (F.col("_number") if "_number" in raw.columns else _row_id_from_file(raw)).alias("row_id"),
        F.col(f"`{code}`").alias("func"),
        F.col(f"`{label}`").alias("label"),
        (F.col(f"`{proj}`") if proj else F.lit("UNKNOWN")).alias("project"),
        F.lit("").alias("cwe"),
    )
    return canonicalise(out)


def load_parquet_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Prepared corpus (S8); pruning and pushdown come from the scan."""
    return spark.read.parquet(path)


def write_corpus(df: DataFrame, path: str, partition_by: Optional[list] = None,
                 mode: str = "overwrite") -> None:
    """Parquet sink of a prepared corpus."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_dataset(spark: SparkSession, name: str, path: Optional[str] = None, **kw) -> DataFrame:
    """Source dispatch by name."""
    from .synthetic import synthetic_corpus
    name = name.lower()
    loaders = {
        "csv": lambda: load_csv_corpus(spark, path),
        "bigvul": lambda: load_csv_corpus(spark, path),
        "json": lambda: load_json_or_csv_corpus(spark, path),
        "devign": lambda: load_json_or_csv_corpus(spark, path),
        "parquet": lambda: load_parquet_corpus(spark, path),
        "synthetic": lambda: synthetic_corpus(spark, **kw),
    }
    if name not in loaders:
        raise ValueError(f"no corpus loader is called {name!r}; known: {sorted(loaders)}")
    return loaders[name]()


def corpus_profile(df: DataFrame, keys: Optional[list] = None, approx: bool = False) -> DataFrame:
    """Rows, positives, % positive and distinct projects."""
    keys = keys or []
    nd = (F.approx_count_distinct("project") if approx else F.countDistinct("project"))
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").cast("long").alias("n_pos"),
        nd.alias("n_projects"),
    ).withColumn("pct_pos", F.when(F.col("n_rows") > 0,
                                   F.lit(100.0) * F.col("n_pos") / F.col("n_rows")).otherwise(F.lit(0.0)))
