import numpy as np

from detecteval.operators import logistic as lg


def newton(x, y, s, steps=50):
    """Plain optimum of the penalised loss, the intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    free = np.diag(np.append(np.ones(x.shape[1] - 1), 0))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (s * p * (1 - p))[:, None]) + free, x.T @ (s * (p - y)) + free @ w)
    return w


def test_keyed_fits_meet_the_optimum_and_resting_fits_cost_no_pass(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((60, 4)) * (rng.random((60, 4)) < 0.6)
    x[:3] = 0  # rows without a term
    y = (rng.random(60) < 0.4).astype(int)
    rows = []
    for i in range(60):
        idx = np.flatnonzero(x[i]).tolist()
        fit = [0, 1] if i % 3 else [1]
        rows.append((int(y[i]), idx, x[i][idx].tolist(), fit, [7.0 if f and y[i] else 1.0 for f in fit]))
    df = spark.createDataFrame(rows, "label int, idx array<int>, val array<double>, fit array<int>, w array<double>")
    asked, plain = [], lg._totals

    def totals(pieces, w, open_):
        asked.append(open_.tolist())
        return plain(pieces, w, open_)
    monkeypatch.setattr(lg, "_totals", totals)
    got = lg.fit_keyed(df, 3, 4, tol=1e-9)  # the third fit has no rows
    own = np.arange(60) % 3 > 0
    assert np.abs(got[0] - newton(x[own], y[own], np.ones(own.sum()))).max() < 1e-7
    assert np.abs(got[1] - newton(x, y, np.where(y == 1, 7.0, 1.0))).max() < 1e-7
    assert not got[2].any()
    assert all(not open_[2] for open_ in asked[1:]) and any(open_ != [True] * 3 for open_ in asked[1:])


def test_a_rows_terms_serve_all_its_tasks(spark):
    texts = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "zz"), (4, "")], "row_id long, func string")
    members = spark.createDataFrame([(t, r, (r + t) % 2 == 1, f"m{t}{r}") for t in (0, 5) for r in (1, 2, 3, 4)],
                                    "task int, row_id long, train boolean, mark string")
    got = {(r["task"], r["row_id"]): r for r in lg.keyed_tfidf(texts, members, 2).collect()}
    assert len(got) == 8 and all(r["mark"] == f"m{t}{i}" for (t, i), r in got.items())
    assert list(got[0, 1]["idx"]) == [0, 1]  # task 0 trains rows 1 and 3: b twice, then a before zz
    u = np.array([1.0, 1 + np.log(2)]) * (np.log(3 / 2) + 1)
    assert np.allclose(got[0, 1]["val"], u / np.sqrt((u * u).sum()), atol=1e-15)
    assert list(got[0, 3]["idx"]) == [] and list(got[0, 4]["val"]) == []
    assert list(got[5, 1]["idx"]) == [0] and got[5, 1]["val"][0] == 1.0  # task 5 trains rows 2 and 4: b, c
    assert list(got[5, 2]["idx"]) == [0, 1]
