"""Prediction tables with evaluation sides, built from the driver tables."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as fo
from ..functions.scalar import logit_from_score
from ..session import checkpoint, written
from . import fixtures as fx
from . import oracle as oq

SEEDS = (0, 1, 2)
N_SPLITS = 5
SIDE_COLS = ("row_id", "project", "cwe", "label")


def corpus_sides(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = SEEDS,
                 n_splits: int = N_SPLITS) -> DataFrame:
    c = checkpoint(fx.corpus(spark, sf_dir).select(*SIDE_COLS))
    f = checkpoint(fo.group_folds(c, n_splits, seeds))
    return checkpoint(fo.evaluation_sides(c, f))


def transfer_pt(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = SEEDS,
                n_splits: int = N_SPLITS, models=None) -> DataFrame:
    """``model, seed, fold, side, row_id, project, cwe, label, score, logit0, logit1``."""
    return checkpoint(fx.with_scores(corpus_sides(spark, sf_dir, seeds, n_splits), models))


def events_transfer_pt(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = SEEDS,
                       n_splits: int = N_SPLITS, models=None) -> DataFrame:
    """The same over events. A row's scores do not hang on (seed, fold, side): they are
    hashed once a row, before its evaluations are told apart, and the table is written
    once, in columns."""
    models = list(models or fx.MODELS)
    c = fx.events_corpus(spark, sf_dir)
    scores = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_{i}").alias("score")) for i, m in enumerate(models)])
    hashed = c.withColumns({f"_{i}": fx.score_expr(model_col=F.lit(m)) for i, m in enumerate(models)})
    c = written(hashed.select(*c.columns, scores.alias("_scores")))
    f = checkpoint(fo.group_folds(c.drop("_scores"), n_splits, seeds))
    sides = fo.evaluation_sides(c, f)
    keep = [x for x in sides.columns if x != "_scores"]
    pt = sides.withColumn("_s", F.explode("_scores")).select(*keep, F.col("_s.model").alias("model"), F.col("_s.score").alias("score"))
    return written(pt.withColumn("logit0", F.lit(0.0)).withColumn("logit1", logit_from_score(F.col("score"))))


def sql_transfer_pt(src: str = "corpus", seeds: Sequence[int] = SEEDS, n_splits: int = N_SPLITS,
                    models=None, name: str = "pt") -> str:
    """CTEs ``folds, sides, <name>`` over an existing corpus-like CTE."""
    models = models or fx.MODELS
    return ",".join([
        oq.folds(src, n_splits, seeds),
        oq.sides(src, "folds", "sides"),
        oq.with_scores(name, "sides", models, ["seed", "fold", "side"] + list(SIDE_COLS)),
    ])
