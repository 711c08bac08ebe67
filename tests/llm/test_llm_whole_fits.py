"""Fits of the toxicity net over every labelled row."""
import numpy as np

from detecteval.llm import toxicity


def test_net_and_thresholds_take_every_labelled_row(spark):
    n = 20_000  # more than any sample of 4,000 rows a label
    rows = [(i, ("filth and grime " if i % 2 else "calm and clean ") + f"w{i % 97} w{i % 89}", "en") for i in range(n)]
    docs = spark.createDataFrame(rows + [(n, "", "en"), (n + 1, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n + 2)], "doc_id long, toxic int")
    seen, plain, plain_outputs = {}, toxicity.train_all, toxicity.outputs

    def watch(table, totals):
        seen["learn"] = (table.count(), sum(totals))
        return plain(table, totals)

    def watch_outputs(table, net):
        out = plain_outputs(table, net)
        seen["calibrate"] = int(out[3].sum())
        return out
    toxicity.train_all, toxicity.outputs = watch, watch_outputs
    try:
        model = toxicity.fit(docs, labels)
    finally:
        toxicity.train_all, toxicity.outputs = plain, plain_outputs
    rest = sum((i // 7) % 4 == 0 for i in range(n))
    assert seen == {"learn": (n - rest, n - rest), "calibrate": rest}
    got = toxicity.score(docs.where("doc_id < 400"), model).collect()
    assert all((r["__score"] >= toxicity.CUT) == (r["__id"] % 2 == 1) for r in got)


def test_moves_of_one_task_are_those_of_learning_in_memory(spark):
    """One partition, one chunk: a distributed round is a round of ``learn`` (up to the half
    precision of the moves); two equal partitions move as far as one."""
    rng = np.random.default_rng(3)
    y = np.arange(300) % 2
    words = [rng.integers(0, 1 << 36, 12) for _ in y]
    for v, w in zip(y, words):
        w[3] = 77 + v
    df = spark.createDataFrame([(int(v), w.tobytes()) for v, w in zip(y, words)], "y int, words binary")
    net = toxicity.train_all(df.coalesce(1), [150, 150], rounds=1, passes=2)
    seen = np.stack([sum(toxicity._texts_with(w, np.array([0, 12])) for v, w in zip(y, words) if v == u) for u in (0, 1)])
    want = toxicity._new_net(np.random.default_rng(7), seen, [150, 150])
    sums, draw = toxicity._first_sums(want), np.random.default_rng([7, 0])
    for _ in range(2):
        toxicity.learn(want, sums, words, y.astype(np.float32), np.ones(300), draw.permutation(300))
    for a, b in zip(toxicity._arrays(net), toxicity._arrays(want)):
        assert np.allclose(a, b, atol=2e-3)
    twice = toxicity.train_all(df.coalesce(1).unionByName(df.coalesce(1)), [300, 300], rounds=1, passes=2)
    assert np.allclose(twice.out, net.out, atol=5e-2)


def test_threshold_of_counted_outputs_is_that_of_the_rows():
    rng = np.random.default_rng(9)
    for _ in range(20):
        z, y, n = np.arange(12) / 2, rng.integers(0, 2, 12), rng.integers(1, 6, 12)
        y[:2] = 0, 1
        assert toxicity.best_threshold(z, y, 4.0, n) == toxicity.best_threshold(np.repeat(z, n), np.repeat(y, n), 4.0)
