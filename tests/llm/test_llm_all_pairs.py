import numpy as np

from detecteval.llm import quality


def test_every_labelled_row_counts_in_the_weights_and_the_cut(spark):
    """Against plain Newton steps over all pairs; a share of the rows alone gives other weights."""
    rng = np.random.default_rng(3)
    n, width = 600, len(quality.FEATURES)
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, width)) + 0.7 * y[:, None] * rng.normal(size=width)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "y int, x array<double>").repartition(3)
    model = quality.fit_all_pairs(table)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    diff = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, width)
    w = np.zeros(width)
    for _ in range(30):
        q = 1 / (1 + np.exp(diff @ w))
        hess = (diff * (q * (1 - q))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(width)
        w = w - np.linalg.solve(hess, -(diff * q[:, None]).mean(axis=0) + 1e-3 * w)
    assert np.abs(model.weights - w).max() < 1e-3
    s = z @ model.weights
    errors = [(s[y == 1] < c).mean() + (s[y == 0] >= c).mean() for c in s]
    assert (s[y == 1] < model.cut).mean() + (s[y == 0] >= model.cut).mean() <= min(errors) + 0.01
    assert abs(model.spread - s.std() / 2) < 1e-6
    assert ((model.score(x) >= quality.CUT) == (s >= model.cut)).all()


def test_fit_takes_more_rows_than_any_sample(spark):
    rows = [(i, ("plain words of an even text " if i % 2 else "BUY !!! 99 $$ ") * 3) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12_000)], "doc_id long, quality int")
    seen, plain = [], quality.fit_all_pairs

    def watch(table):
        seen.append(table.count())
        return plain(table)
    quality.fit_all_pairs = watch
    try:
        model = quality.fit(docs, labels)
    finally:
        quality.fit_all_pairs = plain
    assert seen == [12_000]
    got = quality.score(docs.limit(400), model).collect()
    assert all((r["__score"] >= quality.CUT) == (r["__id"] % 2 == 1) for r in got)
    assert not plain(spark.createDataFrame([(1, [0.0] * 9)], "y int, x array<double>")).known
