"""TF-IDF, scores and attributions are taken row by row: nothing of the size of all (row, term)
pairs is shuffled; repeated and missing ids as before."""
import math
import re
from collections import Counter

import pytest

from detecteval.operators import explain as ex
from detecteval.operators import models as md

ROWS = [(1, "int a = strcpy(b, b); /* a */"), (2, "gets(x) x x"), (3, ""), (4, "b b B_1 zz"), (5, None), (6, "?!")]


def _model(spark, rows, **kw):
    df = spark.createDataFrame(rows, "row_id long, func string")
    tf = md.fit_tfidf(df, **kw)
    w = tf.vocab.select("term", "idx", (tf.vocab.idx * 0.5 - 1.0).alias("coef"))
    return df, tf, w


@pytest.mark.parametrize("rows", [ROWS, ROWS + [(2, "a gets zz"), (4, None)]])
def test_against_plain_python(spark, rows):
    df, tf, w = _model(spark, rows, max_features=6)
    words: dict = {}
    for i, t in rows:
        words.setdefault(i, Counter()).update(re.findall(r"\w+", (t or "").lower()))
    cnt, has = Counter(), Counter()
    for c in words.values():
        cnt.update(c)
        has.update(c.keys())
    terms = sorted(sorted(cnt, key=lambda t: (-cnt[t], t))[:6])
    idf = {t: math.log((1 + len(words)) / (1 + has[t])) + 1 for t in terms}
    assert {r.term: (r.idx, round(r.idf, 9)) for r in tf.vocab.collect()} == {
        t: (k, round(idf[t], 9)) for k, t in enumerate(terms)}
    want = {}
    for i, c in words.items():
        u = {t: (1 + math.log(c[t])) * idf[t] for t in terms if c[t]}
        norm = math.sqrt(sum(x * x for x in u.values()))
        want[i] = {t: x / norm for t, x in u.items()}
    got: dict = {i: {} for i in words}
    for r in md.transform_tfidf(tf, df).collect():
        got[r.row_id][r.term] = r.weight
    for i in want:
        assert got[i] == pytest.approx(want[i])
    vectors = md.features(tf, df).collect()
    assert len(vectors) == len(rows)
    for r in vectors:
        assert dict(zip(r.features.indices.tolist(), r.features.values.tolist())) == pytest.approx(
            {terms.index(t): x for t, x in want[r.row_id].items()})
    score = {i: 1 / (1 + math.exp(-0.25 - sum(x * (terms.index(t) * 0.5 - 1) for t, x in want[i].items()))) for i in want}
    scored = md.linear_score(tf, w, 0.25, df).collect()
    assert sorted((r.row_id, r.func or "") for r in scored) == sorted((i, t or "") for i, t in rows)
    assert all(abs(r.score - score[r.row_id]) < 1e-12 for r in scored)
    ig: dict = {}
    for r in ex.integrated_gradients_linear(tf, w, 0.25, df).collect():
        ig[r.row_id] = ig.get(r.row_id, 0.0) + r.attribution
    base = 1 / (1 + math.exp(-0.25))
    assert all(abs(v - (score[i] - base)) < 1e-12 for i, v in ig.items())
    occ = {(r.row_id, r.term): (r.tf, r.delta) for r in ex.occlusion_linear(tf, w, 0.25, df).collect()}
    assert set(occ) == {(i, t) for i in want for t in want[i]}
    for (i, t), (n, delta) in occ.items():
        c = Counter(words[i])
        c[t] -= 1
        u = {x: (1 + math.log(c[x])) * idf[x] for x in terms if c[x]}
        norm = math.sqrt(sum(x * x for x in u.values()))
        z = 0.25 + (sum(x * (terms.index(k) * 0.5 - 1) for k, x in u.items()) / norm if norm else 0.0)
        assert n == words[i][t] and abs(delta - (score[i] - 1 / (1 + math.exp(-z)))) < 1e-12


def test_nothing_of_the_terms_is_shuffled(spark):
    df, tf, w = _model(spark, ROWS)
    for out in (md.transform_tfidf(tf, df), md.linear_score(tf, w, 0.0, df), ex.occlusion_linear(tf, w, 0.0, df),
                ex.integrated_gradients_linear(tf, w, 0.0, df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Window" not in plan
