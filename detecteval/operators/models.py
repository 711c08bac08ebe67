"""TF-IDF features and Spark ML classifiers with class weights.

TF-IDF is computed as a long table ``(row_id, term, weight)`` with the
exact formula of the reference (top ``max_features`` terms by corpus count,
sublinear tf ``1 + ln tf``, smooth idf ``ln((1+n)/(1+df)) + 1``, L2 norm);
Spark's ``IDF`` omits the ``+1`` and is not used. The vocabulary is fitted
on training rows only and is bounded by ``max_features`` (broadcast with a
proven bound). A row's counts, weights and score hang on its own text alone, so they
are taken row by row from the row's tokens (:func:`per_row`): no table of all
(row, term) pairs is grouped, joined or sorted. Vectors for Spark ML come from such
arrays by way of a written table (:func:`sparse_vectors`).
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Optional, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import word_tokens
from .sampling import hard_balance
from ..session import checkpoint, ensure_checkpoint_dir


@dataclass
class TfidfModel:
    vocab: DataFrame        # term, idx, idf   (<= max_features rows)
    size: int


def term_counts(df: DataFrame, text_col: str = "func", id_col: str = "row_id") -> DataFrame:
    """``(row_id, term, tf)`` from lower-cased word tokens."""
    t = df.select(id_col, F.explode(word_tokens(F.col(text_col))).alias("term"))
    return t.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def _tokens(df: DataFrame, text_col: str, id_col: str, each: bool = False) -> DataFrame:
    """``(id, _tokens)`` with one row per id; rows that share an id are one text.
    With ``each`` every row of ``df`` instead, with its id's tokens (none without an id)."""
    own = word_tokens(F.col(text_col))
    rows = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if rows.isEmpty():
        return (df.withColumn("_tokens", F.when(F.col(id_col).isNotNull(), own)) if each
                else df.select(id_col, own.alias("_tokens")))
    whole = df.select(id_col, own.alias("_tokens")).groupBy(id_col).agg(F.flatten(F.collect_list("_tokens")).alias("_tokens"))
    return df.join(whole, id_col, "left").select(*df.columns, "_tokens") if each else whole


def fit_tfidf(train: DataFrame, max_features: int = 10_000, text_col: str = "func",
              id_col: str = "row_id") -> TfidfModel:
    """Vocabulary and idf from training rows (M1)."""
    n_docs = train.select(id_col).distinct().count()
    s = _tokens(train, text_col, id_col).select(F.sort_array("_tokens").alias("_s"))
    terms = s.select(F.explode(F.transform("_s", lambda t, i: F.struct(
        t.alias("term"), ((i == 0) | (F.get("_s", i - 1) != t)).cast("int").alias("new")))).alias("_e")).select("_e.*")
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"), F.sum("new").alias("df"))
    top = stats.orderBy(F.col("cnt").desc(), F.col("term")).limit(max_features)  # top-k feature
    w = Window.orderBy(F.col("term"))  # over <= max_features rows
    vocab = top.select("term", (F.row_number().over(w) - 1).alias("idx"),
                       (F.ln(F.lit(float(1 + n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    vocab = checkpoint(vocab)
    return TfidfModel(vocab, vocab.count())


class RowTerms:
    """Known terms of some rows: entry i is the term ``idx[i]`` of row ``row[i]``, ``tf[i]``
    times in it, of unnormalised weight ``u[i]``; rows rise, and terms within a row."""

    def __init__(self, n: int, row: np.ndarray, idx: np.ndarray, tf: np.ndarray, idf: np.ndarray):
        self.n, self.row, self.idx, self.tf, self.idf = n, row, idx, tf, idf  # idf of each entry
        self.u = (1.0 + np.log(tf)) * idf

    def only(self, own: np.ndarray) -> "RowTerms":
        return RowTerms(self.n, self.row[own], self.idx[own], self.tf[own], self.idf[own])

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, self.n)

    def weight(self) -> np.ndarray:
        return self.u / np.sqrt(self.total(self.u * self.u))[self.row]

    def lists(self, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        at = np.searchsorted(self.row, np.arange(self.n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def per_row(model: TfidfModel, rows: DataFrame, fields: Sequence[StructField], fn) -> DataFrame:
    """Columns of ``rows`` (the last one ``_tokens``, which goes) and the arrays that
    ``fn(RowTerms)`` gives for ``fields``. The vocabulary is held by every task."""
    vocab = model.vocab.select("term", "idf").orderBy("idx").collect()  # <= max_features rows
    terms, idf, size = [r[0] for r in vocab], np.array([r[1] for r in vocab], float), max(1, len(vocab))
    keep = rows.columns[:-1]

    def run(batches):
        known = pa.array(terms, pa.string())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                tokens = part.column(len(keep))
                row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
                at = pc.fill_null(pc.index_in(tokens.flatten().cast(pa.string()), value_set=known), -1).to_numpy()
                key, tf = np.unique(row[at >= 0] * size + at[at >= 0], return_counts=True)
                found = RowTerms(part.num_rows, key // size, key % size, tf, idf[key % size])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + list(fn(found)),
                                                 names=[*keep, *[f.name for f in fields]])
    schema = StructType([rows.schema[c] for c in keep] + list(fields))
    return rows.mapInArrow(run, schema)


IDX = StructField("idx", ArrayType(IntegerType()))


def numbers(name: str) -> StructField:
    return StructField(name, ArrayType(DoubleType()))


def by_term(model: TfidfModel, arrays: DataFrame, id_col: str, *names: str) -> DataFrame:
    """``(id, term, idx, names)``: one row per term of the arrays."""
    flat = arrays.select(id_col, F.explode(F.arrays_zip("idx", *names)).alias("_e")).select(id_col, "_e.*")
    return flat.join(F.broadcast(model.vocab.select("idx", "term")), "idx").select(id_col, "term", "idx", *names)


def coefficients(model: TfidfModel, weights: DataFrame) -> np.ndarray:
    """Coefficient of each term, NaN without one."""
    coef = np.full(model.size, np.nan)
    for r in weights.select("idx", "coef").collect():  # <= max_features rows
        coef[r[0]] = r[1]
    return coef


def transform_tfidf(model: TfidfModel, df: DataFrame, text_col: str = "func",
                    id_col: str = "row_id") -> DataFrame:
    """Long TF-IDF ``(row_id, term, idx, weight)``, L2-normalised per row."""
    rows = _tokens(df, text_col, id_col).where(F.col(id_col).isNotNull())
    arrays = per_row(model, rows, [IDX, numbers("weight")],
                     lambda t: (t.lists(t.idx, pa.int32()), t.lists(t.weight(), pa.float64())))
    return by_term(model, arrays, id_col, "weight")


#: The struct that stands for a sparse vector in storage.
_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def sparse_vectors(df: DataFrame, size: int, name: str = "features", idx: str = "idx", val: str = "val") -> DataFrame:
    """``df`` with its arrays ``idx`` (rising) and ``val`` as one Spark ML vector.

    A vector is stored as a struct, so the arrays are written in that shape to the
    shared folder of ``spark.checkpoint.dir`` and read back under the vector's type:
    no Python function touches a row, and the lineage is cut."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    flat = df.withColumn(name, F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(int(size)).alias("size"), F.col(idx).alias("indices"),
        F.col(val).alias("values")).cast(_SPARSE)).drop(idx, val)
    flat.write.parquet(place)
    fields = [StructField(f.name, VectorUDT(), True) if f.name == name else f for f in flat.schema.fields]
    return spark.read.schema(StructType(fields)).parquet(place)


def features(model: TfidfModel, df: DataFrame, label: str = "label", id_col: str = "row_id",
             text_col: str = "func") -> DataFrame:
    """Rows without the text, with the ``features`` vector (empty for rows without a known term)."""
    arrays = per_row(model, _tokens(df, text_col, id_col).where(F.col(id_col).isNotNull()), [IDX, numbers("val")],
                     lambda t: (t.lists(t.idx, pa.int32()), t.lists(t.weight(), pa.float64())))
    base = df.drop(text_col) if text_col in df.columns else df
    # a merge join at every size leaves the rows in the order of their ids, which forests draw by
    out = base.join(arrays.hint("merge"), id_col, "left").withColumns({
        "idx": F.coalesce("idx", F.array().cast("array<int>")),
        "val": F.coalesce("val", F.array().cast("array<double>"))})
    return sparse_vectors(out, model.size)


def class_weight_col(label: str = "label", w1: float = 1.0, w0: float = 1.0):
    """``weightCol`` for cost-sensitive training (M5)."""
    return F.when(F.col(label) == 1, F.lit(float(w1))).otherwise(F.lit(float(w0)))


# Classifier settings of the baseline study.
def make_classifier(name: str, iterations: int = 1000, trees: int = 200, depth: int = 30,
                    rounds: int = 200):
    """LR (C=1, 1000 iterations), RF (200 trees, depth 50 -> Spark max 30),
    GBT (200 rounds, depth 5) (M2-M4)."""
    if name == "lr":
        return LogisticRegression(maxIter=iterations, regParam=0.0,
                                  elasticNetParam=0.0, standardization=False, weightCol="w")
    if name == "rf":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth,
                                      weightCol="w", seed=0)
    if name == "gbt":
        return GBTClassifier(maxIter=rounds, maxDepth=5, weightCol="w", seed=0)
    raise ValueError(f"unknown model {name}")


def fit_score(train: DataFrame, score_on: DataFrame, name: str = "lr", w1: float = 1.0,
              balance: bool = False, seed: int = 0, settings: dict | None = None,
              max_features: int = 10_000, reg_c: float = 1.0):
    """Fit TF-IDF + classifier on ``train`` (optionally hard-balanced, M6),
    score ``score_on`` (E1). Returns (scored PT, tfidf, fitted model)."""
    if balance:
        train = hard_balance(train, seed)
    tf = fit_tfidf(train, max_features)
    # Iterative fits re-read their input many times: ``features`` is a written table.
    sc, m = fit_vectors(features(tf, train), features(tf, score_on), name, w1, settings, reg_c)
    return sc, tf, m


def fit_vectors(train: DataFrame, score_on: DataFrame, name: str = "lr", w1: float = 1.0,
                settings: dict | None = None, reg_c: float = 1.0):
    """Fit a classifier on ``train`` and score ``score_on``, both with ``features``."""
    tr = train.withColumn("w", class_weight_col("label", w1))
    clf = make_classifier(name, **(settings or {}))
    if name == "lr":
        total = tr.agg(F.sum("w")).first()[0] or 1.0  # the loss is a weighted mean
        clf = clf.setRegParam(1.0 / (reg_c * total))
    m = clf.fit(tr.withColumn("label", F.col("label").cast("double")))
    sc = m.transform(score_on)
    sc = sc.withColumn("score", vector_to_array("probability")[1]) \
        .withColumn("_raw", vector_to_array("rawPrediction"))
    sc = sc.withColumn("logit0", F.lit(0.0)).withColumn(
        "logit1", F.when(F.lit(name == "lr"), F.col("_raw")[1])
        .otherwise(F.ln((F.col("score") + 1e-7) / (1 - F.col("score") + 1e-7))))
    keep = [c for c in score_on.columns if c != "features"]
    return sc.select(*keep, "score", "logit0", "logit1"), m


def linear_weights(tf: TfidfModel, lr_model) -> DataFrame:
    """``(term, idx, coef)`` of a fitted logistic regression, for closed-form
    scoring and attributions (E5, E6)."""
    coef = lr_model.coefficients.toArray().tolist()
    spark = tf.vocab.sparkSession
    cdf = spark.createDataFrame([(i, float(c)) for i, c in enumerate(coef)], "idx int, coef double")
    return tf.vocab.join(cdf, "idx").select("term", "idx", "coef")


def linear_score(tf: TfidfModel, weights: DataFrame, intercept: float, df: DataFrame,
                 text_col: str = "func", id_col: str = "row_id", name: str = "score") -> DataFrame:
    """sigmoid(b + w.x) of TF-IDF rows, row by row (E1 for linear models; the
    vocabulary-sized weights table is bounded)."""
    coef = np.nan_to_num(coefficients(tf, weights))
    out = per_row(tf, _tokens(df, text_col, id_col, each=True), [StructField("_z", DoubleType())],
                  lambda t: (pa.array(t.total(t.weight() * coef[t.idx]) + intercept),))
    return out.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))).drop("_z")


def score_with(df: DataFrame, predict, text_col: str = "func", id_col: str = "row_id",
               keep: Sequence[str] = ("label",)) -> DataFrame:
    """Bring-your-own scorer (E1): ``predict(pandas.Series of text) ->
    array of P(class 1)`` runs on Arrow batches with ``mapInPandas``; the
    output is a PT with ``score`` and ``logit0 = 0``, ``logit1 = logit(score)``."""
    keep = [c for c in keep if c in df.columns]
    cols = [id_col, text_col] + keep
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{id_col} {types[id_col]}"] + [f"{c} {types[c]}" for c in keep]
                       + ["score double", "logit0 double", "logit1 double"])

    def run(batches):
        for pdf in batches:
            p = np.clip(np.asarray(predict(pdf[text_col]), dtype="float64"), 1e-7, 1 - 1e-7)
            out = pdf[[id_col] + keep].copy()
            out["score"] = p
            out["logit0"] = 0.0
            out["logit1"] = np.log(p / (1 - p))
            yield out

    return df.select(*cols).mapInPandas(run, schema)


# Per-occurrence weights of the lexicon scorer (sinks raise,
# bounds checks lower the score).
LEXICON = {"strcpy": 2.0, "gets": 2.0, "sprintf": 1.5, "strcat": 1.5, "scanf": 1.0,
           "memcpy": 0.5, "if": -0.5, "len": -0.25}


def lexicon_predict(texts):
    """Vectorised keyword scorer used as an example external model."""
    import numpy as np
    z = np.full(len(texts), -1.0)
    for w, c in LEXICON.items():
        z = z + c * texts.str.count(rf"\b{w}\b").to_numpy(dtype="float64")
    return 1.0 / (1.0 + np.exp(-z))
