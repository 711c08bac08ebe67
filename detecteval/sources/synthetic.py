"""Synthetic C-function corpus (S6) and code text derived from corpus rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import H
from .corpus import canonicalise

# Sink statements and CWE ids of the synthetic generator.
SINK_STATEMENTS = ["strcpy(dst, src);", "gets(buf);", "sprintf(buf, fmt, x);", "memcpy(d, s, n);"]
CWES = ["CWE-120", "CWE-119", "CWE-787", "CWE-125"]
SAFE_BODY = "  char buf[64];\n  if (len < 64) { memcpy(buf, src, len); }\n  return 0;"


def _pick(arr, h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in arr]), (h % len(arr)).cast("int") + 1)


def code_text(idx: Column, label: Column, seed) -> Column:
    """Label-dependent C function text: positives call an unsafe sink,
    negatives a bounds-checked copy."""
    sink = _pick(SINK_STATEMENTS, H(seed, "sink", idx))
    vuln_body = F.concat(F.lit("  char buf[10];\n  "), sink, F.lit("\n  return 0;"))
    body = F.when(label == 1, vuln_body).otherwise(F.lit(SAFE_BODY))
    return F.concat(F.lit("int func_"), idx.cast("string"),
                    F.lit("(char *src, int len) {\n"), body, F.lit("\n}"))


def synthetic_corpus(spark: SparkSession, n: int = 400, vuln_ratio: float = 0.0574,
                     n_projects: int = 12, seed: int = 0) -> DataFrame:
    """``spark.range(n)``: project ``proj_{i % n_projects}``, Bernoulli label
    by hash, label-dependent body; if fewer than 4 positives, rows 0-3 are
    forced positive with a strcpy body (S6)."""
    r = spark.range(n).withColumnRenamed("id", "row_id")
    lab = (H(seed, "label", F.col("row_id")) < F.lit(int(vuln_ratio * 4294967296))).cast("int")
    r = r.withColumn("label", lab)
    n_pos = r.agg(F.sum("label")).collect()[0][0] or 0
    if n_pos < 4:
        r = r.withColumn("_forced", F.col("row_id") < 4) \
            .withColumn("label", F.when(F.col("_forced"), 1).otherwise(F.col("label")))
    else:
        r = r.withColumn("_forced", F.lit(False))
    func = F.when(F.col("_forced"), F.concat(
        F.lit("int func_"), F.col("row_id").cast("string"),
        F.lit("(char *src, int len) {\n  char buf[64];\n   strcpy(buf, src);\n  return 0;\n}"))) \
        .otherwise(code_text(F.col("row_id"), F.col("label"), seed))
    cwe = F.when(F.col("_forced"), F.lit("CWE-120")).when(
        F.col("label") == 1, _pick(CWES, H(seed, "cwe", F.col("row_id")))).otherwise(F.lit(""))
    out = r.select("row_id", func.alias("func"), "label",
                   F.concat(F.lit("proj_"), (F.col("row_id") % n_projects).cast("string")).alias("project"),
                   cwe.alias("cwe"))
    return canonicalise(out)


def code_for_rows(df: DataFrame, seed: int = 0) -> DataFrame:
    """Replace ``func`` of existing rows by generated code keyed by row_id
    and label: a code corpus that grows with the given table."""
    return df.withColumn("func", code_text(F.col("row_id"), F.col("label"), seed))
