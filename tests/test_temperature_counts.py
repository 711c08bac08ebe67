from pyspark.sql import functions as F

from detecteval.plans import reports as rp


def _draws(spark):
    rows = [("m" if i % 3 else None, 0, i % 2, "test", i if i % 41 else None, None if i % 29 == 0 else int(i % 5 == 0),
             (i * 37 % 101) / 50 - 1) for i in range(900)]
    return spark.createDataFrame(rows, "model string, seed int, fold int, side string, row_id long, label int, logit1 double"
                                 ).withColumn("logit0", F.lit(0.0))


def test_a_temperature_study_makes_no_row_for_each_size(spark, monkeypatch):
    plain, kept = rp.checkpoint, []

    def checkpoint(df, *a):
        out = plain(df, *a)
        kept.append(out.count())
        return out
    monkeypatch.setattr(rp, "checkpoint", checkpoint)
    got = rp.temperature_study(_draws(spark), [20, 50])
    assert got.count() == 4 and max(kept) <= 404  # 4 groups x 101 margins; all rows by sizes were 1,200
