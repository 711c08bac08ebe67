"""Driver tables as corpora and prediction tables, in Spark and in DuckDB SQL.

``corpus``  = documents JOIN labels USING (doc_id) with row_id=doc_id,
              func=text, label=toxic, project=source, cwe=lang, then P4.
``scored``  = corpus x models with an exact deterministic score
              ``(300*label + H(0, 'score'||model, row_id) % 701) / 1000``.
``scored_events`` = events with label=(event_type='error'), project=user_id.
``scored_lineitem`` (bench only) = lineitem, label=(l_returnflag='R'),
              project=l_suppkey; its key is not unique, so the score hashes
              every integer/string column.

The SQL text of each is a CTE list used by the DuckDB oracles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import H, sql_hash
from ..functions.scalar import logit_from_score
from ..functions.text import WS_CLASS_SQL
from ..operators.prep import preprocess
from ..sources.corpus import canonicalise

# Model salts of the fixture scorer.
MODELS = ["m0", "m1", "m2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    j = docs.join(labels, "doc_id")
    return canonicalise(j.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("func"),
        F.col("toxic").alias("label"), F.col("source").alias("project"),
        F.col("lang").alias("cwe")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess(raw_corpus(spark, sf_dir))


#: Calls of the code fixture; a line of length n becomes a statement with call n % 8.
FIXTURE_CALLS = ["strcpy", "strlen", "fgets", "memcpy", "abs", "sprintf", "gets", "toupper"]


def statements(text):
    """Text as C-like code, whatever its label: every line stays as a comment and
    declares its first run of ASCII letters (x without one) by one call."""
    calls = F.array(*[F.lit(c) for c in FIXTURE_CALLS])
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda ln: F.concat(
        F.lit("  /* "), ln, F.lit(" */ int "),
        F.coalesce(F.nullif(F.regexp_extract(ln, "[A-Za-z]+", 0), F.lit("")), F.lit("x")), F.lit(" = "),
        F.element_at(calls, F.length(ln) % len(FIXTURE_CALLS) + 1), F.lit("("),
        F.length(ln).cast("string"), F.lit(");"))), "\n")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared corpus with its texts as code (:func:`statements`)."""
    return corpus(spark, sf_dir).withColumn("func", statements(F.col("func")))


def sql_code(name: str = "code") -> str:
    """DuckDB CTE of :func:`code_corpus`."""
    calls = ", ".join(f"'{c}'" for c in FIXTURE_CALLS)
    return f"""
{name} AS (SELECT * REPLACE (array_to_string(list_transform(string_split(func, chr(10)), lambda ln:
   '  /* ' || ln || ' */ int ' || coalesce(nullif(regexp_extract(ln, '[A-Za-z]+'), ''), 'x') || ' = '
   || (list_value({calls}))[length(ln) % {len(FIXTURE_CALLS)} + 1] || '(' || CAST(length(ln) AS VARCHAR) || ');'),
   chr(10)) AS func) FROM corpus)"""


def score_expr(label_col="label", id_cols=("row_id",), model_col="model"):
    model = F.col(model_col) if isinstance(model_col, str) else model_col
    h = H(0, F.concat(F.lit("score"), model), *[F.col(c) for c in id_cols])
    return ((F.lit(300) * F.col(label_col) + h % 701).cast("double") / F.lit(1000.0))


def with_scores(df: DataFrame, models=None, id_cols=("row_id",)) -> DataFrame:
    """Prediction table: one row per (model, row) with score and logits.

    Models are expanded with ``explode`` of a literal array (no join).
    """
    models = models or MODELS
    out = df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    out = out.withColumn("score", score_expr(id_cols=id_cols))
    return (out.withColumn("logit0", F.lit(0.0))
            .withColumn("logit1", logit_from_score(F.col("score"))))


def scored(spark: SparkSession, sf_dir: str, models=None) -> DataFrame:
    c = corpus(spark, sf_dir).select("row_id", "project", "cwe", "label")
    return with_scores(c, models)


def events_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("project"),
        F.lit("").alias("cwe"),
        (F.col("event_type") == "error").cast("int").alias("label"))


def scored_events(spark: SparkSession, sf_dir: str, models=None) -> DataFrame:
    return with_scores(events_corpus(spark, sf_dir), models)


def scored_fine(spark: SparkSession, sf_dir: str, models=None) -> DataFrame:
    """Events with scores on a grid of 2^33 steps: nearly every row has its own."""
    out = events_corpus(spark, sf_dir).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models or MODELS])))
    h = H(0, F.concat(F.lit("fine"), F.col("model")), F.col("row_id"))
    return out.withColumn("score", (h + F.col("label") * F.lit(1 << 31)).cast("double") / F.lit(float(1 << 33)))


def scored_lineitem(spark: SparkSession, sf_dir: str, models=None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    (F.col("l_quantity") * 100).cast("long"),
                    (F.col("l_extendedprice") * 100).cast("long"),
                    (F.col("l_discount") * 100).cast("long"),
                    (F.col("l_tax") * 100).cast("long"),
                    "l_returnflag", "l_linestatus",
                    F.date_format(F.col("l_shipdate"), "yyyyMMddHHmmss")).alias("row_key"),
        F.col("l_suppkey").cast("string").alias("project"),
        F.lit("").alias("cwe"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return with_scores(base, models, id_cols=("row_key",))


# --------------------------------------------------------------- SQL side
def sql_models(models=None) -> str:
    models = models or MODELS
    return "(VALUES " + ", ".join(f"('{m}')" for m in models) + ") AS mm(model)"


def sql_ws_norm(x: str) -> str:
    return ("regexp_replace(regexp_replace(regexp_replace(" + x + ", '" + WS_CLASS_SQL
            + "', ' ', 'g'), '^ ', ''), ' $', '')")


def sql_nlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')) + 1)"


def sql_ctes(models=None) -> str:
    """``corpus_raw, corpus, scored, events_corpus, scored_events, scored_fine`` CTEs."""
    h_c = sql_hash("0", "'score' || mm.model", "c.row_id")
    h_e = sql_hash("0", "'score' || mm.model", "e.row_id")
    h_f = sql_hash("0", "'fine' || mm.model", "e.row_id")
    return f"""
corpus_raw AS (
  SELECT d.doc_id AS row_id, d.text AS func, CAST(CAST(CAST(l.toxic AS VARCHAR) AS DOUBLE) AS INTEGER) AS label,
         coalesce(nullif(CAST(d.source AS VARCHAR), ''), 'UNKNOWN') AS project,
         coalesce(CAST(d.lang AS VARCHAR), '') AS cwe
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND length(d.text) > 0),
corpus_keyed AS (
  SELECT *, row_number() OVER (PARTITION BY {sql_ws_norm('func')} ORDER BY row_id) AS _rn
  FROM corpus_raw),
corpus AS (
  SELECT row_id, func, label, project, cwe FROM corpus_keyed
  WHERE _rn = 1 AND {sql_nlines('func')} BETWEEN 5 AND 500),
scored AS (
  SELECT mm.model, c.row_id, c.project, c.cwe, c.label,
         CAST(300 * c.label + {h_c} % 701 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score
  FROM corpus c CROSS JOIN {sql_models(models)}),
events_corpus AS (
  SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS project, '' AS cwe,
         CAST(event_type = 'error' AS INTEGER) AS label FROM events),
scored_events AS (
  SELECT mm.model, e.row_id, e.project, e.cwe, e.label,
         CAST(300 * e.label + {h_e} % 701 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score
  FROM events_corpus e CROSS JOIN {sql_models(models)}),
scored_fine AS (
  SELECT mm.model, e.row_id, e.project, e.cwe, e.label,
         CAST({h_f} + e.label * {1 << 31} AS DOUBLE) / CAST({1 << 33} AS DOUBLE) AS score
  FROM events_corpus e CROSS JOIN {sql_models(models)})"""


def with_ctes(body_ctes: str, select: str, models=None) -> str:
    """Compose the fixture CTEs, extra CTEs and a final SELECT."""
    extra = (",\n" + body_ctes) if body_ctes.strip() else ""
    return f"WITH RECURSIVE {sql_ctes(models)}{extra}\n{select}"
