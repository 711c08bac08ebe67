"""Labels meet features instead of texts."""
from detecteval.llm import quality


def test_labels_meet_features_not_texts(spark):
    """The join of op6's fit stands above the feature function, so no text travels to it."""
    docs = spark.createDataFrame([(i, "a b c " * (i + 1)) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    plans, plain = [], quality.written

    def watch(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)
    quality.written = watch
    try:
        quality.fit(docs, labels)
    finally:
        quality.written = plain
    assert plans[0].index("Join") < plans[0].index("MapInArrow")
