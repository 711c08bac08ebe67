from pyspark.sql import functions as F

from detecteval.operators import folds as fo
from detecteval.plans import fixtures as fx
from detecteval.plans import pt as ptm


def test_events_scores_are_hashed_before_the_rows_are_multiplied(spark, tmp_dir, monkeypatch):
    kinds = ["error", "view", "click", None]
    rows = [(i if i % 50 else None, i % 11 if i % 37 else None, kinds[i * 7 % 13 % 4]) for i in range(400)] * 2
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_dir}/events.parquet")
    plain, seen = fo.evaluation_sides, []

    def sides(df, folds, *a, **k):
        seen.append(df.columns)
        return plain(df, folds, *a, **k)
    monkeypatch.setattr(fo, "evaluation_sides", sides)
    got = ptm.events_transfer_pt(spark, tmp_dir)
    assert "_scores" in seen[0]
    c = fx.events_corpus(spark, tmp_dir)
    want = fx.with_scores(plain(c, fo.group_folds(c, ptm.N_SPLITS, ptm.SEEDS)))
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert got.count() == want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
