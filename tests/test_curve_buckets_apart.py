from pyspark.sql import functions as F

from detecteval.operators import curves as cv


def test_buckets_of_one_key_are_summed_by_several_tasks(spark):
    rows = [("a" if i % 9 else None, i * 37 % 4001 / 4001, int(i % 5 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "model string, score double, label int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cur = cv.pr_curve(df, ["model"], n_buckets=16)
        tasks = cur.where("model = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 2
    plain = cv.pr_curve(df.where("model = 'a'"), ["model"], n_buckets=1)
    assert cur.where("model = 'a'").exceptAll(plain).count() == 0 and plain.exceptAll(cur).count() == 0
