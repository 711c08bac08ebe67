"""Language mixture, pairwise quality and the toxicity net against plain Python."""
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from detecteval.llm import arrays, language, quality, toxicity
from detecteval.session import ensure_importable


@pytest.fixture(autouse=True)
def importable(spark):
    ensure_importable(spark)


def plain_em(words, pi, rounds):
    """EM for one text: words is a list of likelihoods by language."""
    for _ in range(rounds):
        joint = [[l * p for l, p in zip(w, pi)] for w in words]
        part = [[j / max(sum(row), 1e-30) for j in row] for row in joint]
        pi = [sum(row[k] for row in part) / len(words) for k in range(len(pi))]
    return pi, sum(math.log(max(sum(l * p for l, p in zip(w, pi)), 1e-30)) for w in words)


def plain_mixture(words, penalty=0.5):
    """The language set by penalised likelihood: the smallest share leaves while that costs little."""
    langs = len(words[0])
    words = [[math.exp(l - max(w)) for l in w] for w in words]
    pi, fitted = plain_em(words, [1 / langs] * langs, 8)
    active = [True] * langs
    for _ in range(langs - 1):
        drop = min((k for k in range(langs) if active[k]), key=lambda k: pi[k])
        trial = [0.0 if k == drop or not active[k] else max(pi[k], 1e-6) for k in range(langs)]
        trial, value = plain_em(words, [t / sum(trial) for t in trial], 4)
        if value < fitted - penalty * math.log(len(words)):
            break
        pi, fitted, active[drop] = trial, value, False
    return pi


def test_mixtures_against_a_plain_loop():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 7, 40, 0, 300, 15]
    lik = np.log(rng.dirichlet(np.ones(5) * 0.4, sum(sizes)) + 1e-6)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    got = language.mixtures(lik, offsets)
    for d, n in enumerate(sizes):
        want = plain_mixture(lik[offsets[d]:offsets[d + 1]].tolist()) if n else [0.0] * 5
        assert np.allclose(got[d], want, atol=1e-9), d


def test_trigram_model_counts_every_letter(spark):
    """log_p is the smoothed share of each trigram cell among the letters of a language's texts."""
    rows = [(1, "Ab ab", "x"), (2, "ab, zz!", "x"), (3, "été zz", "y"), (4, None, "x"), (5, "no lang", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, "text", "lang", "doc_id")
    assert model.languages == ["x", "y"]
    for j, lang in enumerate(model.languages):
        counts = np.full(language.CELLS, 0.5)
        for _, text, l in rows:
            if text and l == lang:
                w = language.letter_words(next(arrays.text_pieces(pa.array([text]))))
                assert len(w.cells) == sum(c.isalpha() for c in text)
                for cell in w.cells.tolist():
                    counts[cell] += 1
        assert np.allclose(model.log_p[:, j], np.log(counts / counts.sum()), atol=1e-5)


def test_dirty_language_column_is_bounded(spark):
    """The values with the most rows are learned; the others have no say, and their rows are still predicted."""
    rows = [(i, "the quick brown fox of the house", "en") for i in range(40)]
    rows += [(100 + i, "der schnelle braune fuchs vom haus", "de") for i in range(30)]
    rows += [(200 + i, "the house", f"junk{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, "text", "lang", "doc_id", most_languages=2)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert len(got) == 370 and {got[i] for i in range(40)} == {"en"} and {got[100 + i] for i in range(30)} == {"de"}
    assert language.fit(docs, "text", "lang", "doc_id", most_languages=4).languages == ["de", "en", "junk000", "junk001"]


def test_preference_weights_minimise_the_pairwise_loss():
    """Plain gradient steps on the same pairs end at the weights found, and ties in strength share a score."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 80)
    x = rng.normal(size=(80, 3)) + 0.6 * y[:, None] * np.array([1.0, -0.5, 0.0])
    model = quality.fit_pairs(x, y, pairs=400)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    draw = np.random.default_rng(6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = (z[draw.choice(good, 400)] - z[draw.choice(bad, 400)]).tolist()
    w = [0.0, 0.0, 0.0]
    for _ in range(1500):
        grad = [1e-3 * a for a in w]
        for row in diff:
            lost = 1 / (1 + math.exp(sum(a * b for a, b in zip(row, w))))
            for k in range(3):
                grad[k] -= row[k] * lost / len(diff)
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    assert np.allclose(model.weights, w, atol=1e-3)
    twice = model.score(np.concatenate((x, x)))
    assert (twice[:80] == twice[80:]).all() and (np.argsort(twice[:80], kind="stable") == np.argsort(z @ model.weights, kind="stable")).all()


def test_net_output_against_loops():
    """Word vectors, filters over blank-padded windows, maxima, rectifier and output, one text at a time."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 1 << 36, n) for n in (1, 2, 3, 30)] + [np.zeros(0, np.int64)]
    y = np.array([1, 0, 1, 0], np.float32)
    net = toxicity.train(texts[:4], y, epochs=2)
    got = toxicity.logits(net, np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    for text, value in zip(texts, got):
        pooled = np.zeros(len(toxicity.SIZES) * toxicity.FILTERS)
        if len(text):
            vec = [net.vectors(text[i:i + 1])[0].astype(float) for i in range(len(text))]
            blank = np.zeros(toxicity.WIDTH)
            for s, w in enumerate(toxicity.SIZES):
                for f in range(toxicity.FILTERS):
                    outs = [sum((vec[i + j] if i + j < len(vec) else blank) @ net.taps[s][j][:, f] for j in range(w))
                            for i in range(len(vec))]
                    pooled[s * toxicity.FILTERS + f] = max(outs)
        want = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias[0]
        assert abs(value - want) < 1e-3 * max(1, abs(want))


def test_best_threshold_against_every_cut():
    rng = np.random.default_rng(8)
    for _ in range(20):
        z, y = rng.integers(0, 12, 40).astype(float), rng.integers(0, 2, 40)
        gain = lambda t: (z[y == 1] > t).mean() - 4.0 * (z[y == 0] > t).mean()
        cuts = [v + d for v in range(-2, 14) for d in (0.0, 0.5)]
        assert abs(gain(toxicity.best_threshold(z, y, 4.0)) - max(map(gain, cuts))) < 1e-9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_of_empty_tables_ties_and_clashing_names(spark, module):
    label = "quality" if module is quality else "toxic"
    good, bad = "A calm and clean line of words. ", "BUY BUY $$$ !!! 99 filth "
    docs = spark.createDataFrame([(i, (bad if i % 2 else good) * (2 + i % 5), "en") for i in range(120)],
                                 "doc_id long, text string, lang string")
    value = (F.col("doc_id") % 2 == 0) if module is quality else (F.col("doc_id") % 2 == 1)
    labels = docs.select("doc_id", value.cast("int").alias(label))
    model = module.fit(docs, labels.unionByName(labels))  # repeated labels count once
    once = module.fit(docs, labels)
    assert {r["__id"]: r["__score"] for r in module.score(docs, model).collect()} == {
        r["__id"]: r["__score"] for r in module.score(docs, once).collect()}
    empty = docs.limit(0)
    assert module.score(empty, model).count() == 0
    assert len(module.score(docs, module.fit(empty, labels)).collect()) == 120
    clash = docs.withColumns({"k": F.lit(7), "y": F.lit(9), "words": F.lit("w"), "score": F.lit(0.5)})
    got = module.score(clash, module.fit(clash, labels), carry=["k", "y", "words", "score"]).collect()
    assert len(got) == 120 and {(r.k, r.y, r.words, r.score) for r in got} == {(7, 9, "w", 0.5)}
    by_text = {}
    for r in module.score(docs.unionByName(docs), model).join(docs.withColumnRenamed("doc_id", "__id"), "__id").collect():
        by_text.setdefault(r.text, set()).add(r["__score"])
    assert all(len(v) == 1 for v in by_text.values())  # equal texts, equal scores
