"""Training-data pipeline over the documents table: five stages, each one of
the operators of ``detecteval.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of the documents table; the last returns the token digests of
all that is left. Between stages the documents are written as Parquet and read
again. Models are fitted on the stage's own input, whatever labels it has.

Defined cases, for every stage: null text counts as empty; nulls in other columns are
kept as they are; repeated rows are decided one by one; an empty table gives an empty
table; columns beyond those of documents are dropped. Without labels of both kinds the
classifiers keep every document.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detecteval.llm import bpe, neardup, quality, raking, toxicity
from detecteval.llm.catalog import table, vocabulary_path
from detecteval.session import ensure_checkpoint_dir, ensure_importable, remove_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, carry=COLUMNS)
    return scored.where(F.col("__score") >= quality.CUT).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cut."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=COLUMNS)
    return scored.where(F.col("__score") < toxicity.CUT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one of smallest doc_id (null ids
    last), the first in the table of several. Each row is its own document here, also
    where a doc_id repeats or is null, so no text goes that has no kept near-duplicate,
    and of equal rows one stays. Rows without words all stay."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())  # ``docs`` is a table as read: stable numbers
    found = written(neardup.near_duplicates(rows, key="__row").where("n_shingles > 0")
                    .select(F.col("doc_id").alias("__row"), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    member = found.join(rows.select("__row", "doc_id"), "__row")
    group = member.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best")).where("n > 1")
    gone = member.join(group, "component_id").where("__row <> best.__row").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the raked probabilities of their cells."""
    return raking.mix(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [("quality", drop_low_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("mixing", mix_to_targets), ("tokens", tokenize)]

#: Trained classifiers cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each one's documents are written to the
    shared folder of ``spark.checkpoint.dir`` and read again. A stage's table goes
    as soon as the next one stands; that of the last but one stays for the result."""
    ensure_importable(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
