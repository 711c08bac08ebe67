"""Operators 11 to 13 against brute force, on small tables with odd rows."""
import collections
import hashlib
import math
import os
import random
import re
import sys
from fractions import Fraction

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle_check import compare, duck  # noqa: E402

from detecteval.llm import catalog, decontam, phrases, whiten  # noqa: E402
from detecteval.session import ensure_importable  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    ensure_importable(spark)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- phrases ------------------------------------------------------------------------

def truth_phrases(rows, most=3, least=10, top=2000, held_by=50):
    """Brute force over (text, lang)."""
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        score, _, left, right = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])],
                                     f[(lang, *w[k:])]) for k in range(1, len(w)))
        longer = [b for (la, *v), b in found.items() if la == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= held_by * a for b in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -score) for lang, rows in out.items()
            for r, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


PHRASE_ROW = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


@pytest.fixture(scope="module")
def talk(spark):
    """Common words and ties, control characters inside words, repeated rows, odd langs."""
    rng = random.Random(5)
    words = ["the", "The", "of", "a", "a\x01", "a\x1f", "ß", "Éé", "x", "zz", "new", "york", "city"]
    rows = []
    for i in range(260):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", " , "]) for _ in range(rng.randrange(60)))
        rows.append((i % 200, text + "new york city " * (i % 3), rng.choice(["en", "de", None, "und", "pt br"])))
    rows += [(1, "again and again", "en")] * 12 + [(None, None, "en"), (3, "", None), (4, " . ,", "en"), (5, "w " * 5000, "fr")]
    return rows, spark.createDataFrame([(*r, 1, "p", 7) for r in rows],
                                       "doc_id long, text string, lang string, rank int, phrase string, n int")


def test_phrases_against_brute_force(spark, talk):
    rows, frame = talk
    want = truth_phrases([r[1:] for r in rows])
    got = [tuple(r[c] for c in PHRASE_ROW) for r in phrases.collocations(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_phrases_top_and_other_parameters(spark, talk):
    rows, frame = talk
    got = {tuple(r[c] for c in PHRASE_ROW) for r in phrases.collocations(frame, most=4, least=5, top=7, held_by=80, salts=3).collect()}
    assert got == truth_phrases([r[1:] for r in rows], 4, 5, 7, 80)


def test_phrase_counts_do_not_depend_on_chunks_and_ranges(spark, talk):
    rows, frame = talk
    want = collections.Counter()
    for text, lang in (r[1:] for r in rows):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", m, " ".join(w[i:i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
            want[(lang or "und", 0, "")] += len(w)
    want = {k: v for k, v in want.items() if v >= 10 or not k[1] and v}
    for chunk in (1, 7, 100_000):
        got = {(r["lang"], r["size"], r.phrase): r.times for r in phrases.frequent(frame.repartition(5), chunk_rows=chunk).collect()}
        assert got == want


def test_phrases_of_empty_tables(spark, talk):
    _, frame = talk
    assert phrases.collocations(frame.limit(0)).count() == 0
    assert phrases.collocations(frame.where("text is null or text = ''")).count() == 0


def test_multikey_quicksort_counts_prefixes():
    rng = np.random.default_rng(3)
    n = 3000
    columns = [rng.integers(0, 3, n)] + [rng.integers(0, 9, n) for _ in range(3)]
    for d in (2, 3):
        columns[d] = np.where((columns[d] == 8) | (columns[d - 1] < 0), -1, columns[d])
    columns[3] = np.where(columns[2] < 0, -1, columns[3])
    weights = rng.integers(1, 4, n)
    for least in (1, 30):
        for d, (member, total) in enumerate(phrases.multikey_quicksort(columns, weights, least)):
            want = collections.Counter()
            for i in range(n):
                if d == 0 or columns[d][i] >= 0:
                    want[tuple(int(c[i]) for c in columns[:d + 1])] += int(weights[i])
            got = {tuple(int(c[m]) for c in columns[:d + 1]): int(t) for m, t in zip(member, total)}
            assert got == {k: v for k, v in want.items() if v >= least}


def test_suffix_ranks_wide_rows():
    """Rows too wide for 63 bits are numbered anew and still come out in order."""
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 1 << 40, 500) for _ in range(3)]
    columns = [np.append(c, c[:100]) for c in columns]
    got, times = phrases._distinct(columns, 1 << 40)
    want = collections.Counter(zip(*(c.tolist() for c in columns)))
    assert list(zip(*(c.tolist() for c in got))) == sorted(want)
    assert times.tolist() == [want[k] for k in sorted(want)]


# -- decontamination ------------------------------------------------------------------

LEAK_ROW = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"


def truth_leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    holders = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size and item is not None else 0):
            holders[tuple(w[i:i + size])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in holders}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in holders:
                    hit.update(range(i, i + size))
                    found |= holders[tuple(w[i:i + size])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(11)
    vocab = ["ab", "É", "c3", "dd", "ü2", "foo", "bar"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", "'s", "-"]) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(12)]
    items += [(20, "foo bar c3"), (21, "zebra"), (22, ""), (23, None), (None, text(12)), (0, text(15)), (24, items[3][1]),
              (25, "dd " * 30), (100, "one two three four five six seven eight nine")]
    docs = []
    for i in range(60):
        part = rng.choice(items[:12])[1].upper() if i % 2 else ""
        docs.append((i, text(rng.randrange(30)) + " ... " + part + "!" + text(rng.randrange(30))))
    docs += [(5, docs[5][1]), (5, "other text"), (None, docs[1][1]), (None, None), (70, ""), (71, "dd " * 4000),
             (72, "Zebra zebra"), (73, "one two three four five six seven eight nine"), (74, "one two three")]
    return docs, items


def test_decontamination_against_brute_force(spark, leaks):
    docs, items = leaks
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, token long, words string")
    bench = spark.createDataFrame([(*d, "y", 2) for d in items], "item_id long, text string, doc_id string, n_hit int")
    got = sorted((tuple(r[c] for c in LEAK_ROW) for r in decontam.decontaminate(frame, bench).collect()), key=repr)
    assert got == truth_leaks(docs, items)
    small = decontam.decontaminate(frame, bench, window=6, shingle=2).collect()
    assert sorted((tuple(r[c] for c in LEAK_ROW) for r in small), key=repr) == truth_leaks(docs, items, 6)


def test_decontamination_of_empty_tables(spark, leaks):
    docs, items = leaks
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(frame.limit(0), bench).count() == 0
    got = decontam.decontaminate(frame, bench.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.contaminated or r.n_hit for r in got)


@pytest.mark.parametrize("name", ["op11_suffix_phrases", "op12_prefix_decontamination"])
def test_queries_against_sql(spark, name):
    query, sql = catalog.QUERIES[name]
    ok, _, message = compare(query(spark, SMALL), duck(SMALL), sql)
    assert ok, message


# -- whitening ------------------------------------------------------------------------

def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = (q.astype(np.longdouble) * np.array(values, np.longdouble)) @ q.T.astype(np.longdouble)
    return ((a + a.T) / 2).astype(float)


@pytest.mark.parametrize("values", [
    list(range(40, 0, -1)), [5.0] * 6 + [1.0] * 6, [1 + 1e-9 * k for k in range(12)], [1e9, 1e9 - 1e-3, 1e9 - 2e-3, 5, 4, 1e-3],
    [3.0], [0.0, 0.0], [2.0, 1.0, 0.0, 0.0]])
def test_eigenvectors_to_double_precision(values):
    a = symmetric(values)
    e, x = whiten.eigenvectors(a)
    size = max(np.abs(a).max(), 1e-300)
    wide = x.astype(np.longdouble)
    assert np.all(np.diff(e) <= 0)
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 1e-15
    assert np.abs(a.astype(np.longdouble) @ wide - wide * e).max() < 4e-16 * size * max(1, math.sqrt(len(a)))
    assert np.allclose(e, sorted(values, reverse=True), rtol=1e-14, atol=1e-14 * size)


def truth_whitening(rows):
    """Exact covariance and deviations; numpy's double eigenvectors."""
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v) and len(v) == 6]
    n = len(kept)
    total = [sum(x[j] for _, x in kept) for j in range(6)]
    v = [[float(sum(Fraction(n * x[i] - total[i]) * (n * x[j] - total[j]) for _, x in kept) / n ** 3) for j in range(6)]
         for i in range(6)]
    e, q = np.linalg.eigh(np.array(v))
    return kept, n, total, e[::-1], q[:, ::-1], np.trace(np.array(v))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1, .5, .2, .1]).round(4).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (400, None), (401, []), (402, [1.0] * 5 + [None]),
             (403, [1.0] * 5 + [float("nan")]), (404, [float("inf")] * 6), (405, [1.0, 2.0]), (406, [4e5, 1.0, 1.0, 1.0, 1.0, -4e5]),
             (407, [1e300] * 6)]
    return rows


def test_whitening_against_exact_sums(spark, vectors):
    rows = [r for r in vectors if r[0] != 407]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in vectors], "vec_id long, embedding array<double>, n int, whitened double")
    got = whiten.whiten(frame.repartition(3)).collect()
    kept, n, total, e, q, trace = truth_whitening(rows)
    assert len(got) == n * 6 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-7
    want = collections.defaultdict(list)
    for i, x in kept:
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, total)])
        want[i].append((sum((n * a - s) ** 2 for a, s in zip(x, total)), centred @ q / np.sqrt(e)))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        deviation, z = want[r.vec_id][0]
        assert r.deviation == (deviation if deviation < 2 ** 63 else None)
        c = r.component - 1
        sign.setdefault(c, np.sign(r.whitened * z[c]))
        assert abs(r.whitened - sign[c] * z[c]) < 1e-6 * max(1, abs(z[c]))
        assert abs(r.explained - e[c] / trace) < 1e-9


def test_whitening_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None), (2, [])], shape)).count() == 0
    one = whiten.whiten(spark.createDataFrame([(1, [0.5, 1.5])], shape)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == \
        [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whiten.whiten(spark.createDataFrame([(i, [float(i), float(i), 2.0]) for i in range(5)], shape)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12
    assert np.allclose(sorted(r.whitened for r in line if r.component == 1), (np.arange(5) - 2) / math.sqrt(2))


def test_deviation_beyond_64_bits_is_null(spark):
    frame = spark.createDataFrame([(1, [1e14]), (2, [-1e14]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whiten.whiten(frame).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None


def test_integers_follow_floor():
    import pyarrow as pa
    column = pa.array([[0.1, -0.1], [float(np.float32(0.3)), 1e-9], [2.0 ** 50, -2.0 ** 51 + 0.5]], pa.list_(pa.float64()))
    (rows, x), = whiten.integers(column, 1024, 100000)
    assert rows.tolist() == [0, 1, 2]
    assert x.tolist() == [[math.floor(1024 * c) + 100000 for c in v] for v in column.to_pylist()]
