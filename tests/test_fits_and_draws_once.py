import numpy as np
from pyspark.sql import functions as F

from detecteval.operators import logistic as lg
from detecteval.operators import sampling as sa


def test_a_rows_terms_are_stored_once_for_all_tasks(spark, monkeypatch):
    words = ["ab cd ef", "ab ab gh", "cd gh gh ij", "ef ij", "", "zz"]
    texts = spark.createDataFrame([(i, i % 2, words[i % 6]) for i in range(24)], "row_id long, label int, func string")
    sides = spark.createDataFrame([(t, i, "test" if i % 4 == t else "train") for t in range(3) for i in range(24)],
                                  "task int, row_id long, side string")
    plan = spark.createDataFrame([(t, t, 1.0 + t) for t in range(3)], "fit int, task int, w1 double")
    plain, seen = lg.fit_keyed, []

    def fit(rows, *a, **k):
        seen.append(rows.count())
        return plain(rows, *a, **k)
    monkeypatch.setattr(lg, "fit_keyed", fit)
    got = {(r["fit"], r["row_id"]): r["margin"] for r in lg.run_protocol(texts, sides, plan, tol=1e-9).collect()}
    assert seen == [24] and len(got) == 18  # one row each, not one for each of its tasks
    members = sides.groupBy("task", "row_id").agg(F.max(F.col("side") == "train").alias("train"))
    rows = lg.keyed_tfidf(texts, members.join(texts.select("row_id", "label"), "row_id")).collect()
    size = 1 + max(i for r in rows for i in r["idx"])
    for t in range(3):
        x, y, own = np.zeros((24, size + 1)), np.zeros(24), np.zeros(24, bool)
        x[:, -1] = 1
        for r in (r for r in rows if r["task"] == t):
            x[r["row_id"], list(r["idx"])], y[r["row_id"]], own[r["row_id"]] = r["val"], r["label"], r["train"]
        s, free, w = np.where(y == 1, 1.0 + t, 1.0) * own, np.diag(np.append(np.ones(size), 0)), np.zeros(size + 1)
        for _ in range(40):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve(x.T @ (x * (s * p * (1 - p))[:, None]) + free, x.T @ (s * (p - y)) + free @ w)
        assert max(abs(got[t, i] - x[i] @ w) for i in range(24) if not own[i]) < 1e-6


def _draws(spark):
    rows = [("m" if i % 3 else None, 0, i % 2, "test", i if i % 41 else None, None if i % 29 == 0 else int(i % 5 == 0),
             (i * 37 % 101) / 50 - 1) for i in range(900)]
    return spark.createDataFrame(rows, "model string, seed int, fold int, side string, row_id long, label int, logit1 double"
                                 ).withColumn("logit0", F.lit(0.0))


def test_drawn_rows_are_those_of_the_whole_draw(spark):
    df, keys = _draws(spark), ["model", "seed", "fold"]
    whole = sa.calibration_draw(df, [20, 50, 250], F.col("seed") + F.col("fold"), keys).where("part = 'cal'")
    got = sa.calibration_rows(df, [20, 50, 250], F.col("seed") + F.col("fold"), keys)
    cols = sorted(got.columns)
    assert got.count() == whole.count() > 0 and got.select(cols).exceptAll(whole.select(cols)).count() == 0
