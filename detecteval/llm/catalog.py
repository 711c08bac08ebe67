"""Queries of the operators: name -> (builder, DuckDB SQL or None)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, cws, decontam, language, neardup, phrases, quality, raking, revisit, toxicity, urlrules,
               whiten)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2(spark, sf_dir):
    return cws.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, "text", "lang", "doc_id", fold("doc_id", 5) != 0)
    out = language.predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "languages")


def op4(spark, sf_dir):
    return raking.mix(table(spark, sf_dir, "documents"))


def op5(spark, sf_dir):
    out = revisit.resolve(revisit.records_of_pages(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", revisit.flat(F.col("headers")))


def _scored(out: DataFrame, held_out, cut: float) -> DataFrame:
    return out.select(F.col("__id").alias("doc_id"), held_out.alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= cut).cast("int").alias("predicted"))


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda k: fold(k, 5) != 0)
    return _scored(quality.score(docs, model), fold("__id", 5) == 0, quality.CUT)


def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda k: fold(k, 3) != 1)
    return _scored(toxicity.score(docs, model), fold("__id", 3) == 1, toxicity.CUT)


def op8(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9(spark, sf_dir):
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op10(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op11(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12(spark, sf_dir):
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_learned_partitions": (op1, None),
    "op2_weighted_sampling": (op2, None),
    "op3_language_mixture": (op3, None),
    "op4_raking": (op4, raking.sql()),
    "op5_revisits": (op5, revisit.SQL),
    "op6_pairwise_quality": (op6, None),
    "op7_conv_toxicity": (op7, None),
    "op8_hamming_join": (op8, None),
    "op9_path_templates": (op9, None),
    "op10_byte_bpe": (op10, None),
    "op11_suffix_phrases": (op11, phrases.SQL),
    "op12_prefix_decontamination": (op12, decontam.SQL),
    "op13_refined_whitening": (op13, None),
}
