"""Kernels of the llm operators against brute force, without Spark."""
import base64
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from detecteval.llm import ann, arrays, bpe, cws, language, neardup, quality, raking, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def whole(texts):
    return list(arrays.text_pieces(pa.array(texts, pa.string()), max_bytes=200))


def test_pieces_cover_all_texts_and_take_null_as_empty():
    texts = ["a", None, "", "b" * 500, "é" * 30, "end"]
    got = [bytes(p.text_bytes(i)).decode() for p in whole(texts) for i in range(p.hi - p.lo)]
    assert got == ["" if t is None else t for t in texts]
    counts = np.concatenate([arrays.char_counts(p) for p in whole(texts)])
    assert counts.tolist() == [len(t or "") for t in texts]
    assert list(arrays.text_pieces(pa.array([], pa.string()))) == []


def test_words_and_shingles_match_a_plain_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab C\t\n\x0b é") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "one"]
    seen = {}
    for p in whole(texts):
        words = arrays.split_words(arrays.lower_ascii(p.data), p.offsets)
        sh, offs = arrays.shingles(words, 5)
        for i in range(p.hi - p.lo):
            w = WORD.findall(lower(texts[p.lo + i]))
            assert words.offsets[i + 1] - words.offsets[i] == len(w)
            want = [tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))] if w else []
            own = sh[offs[i]:offs[i + 1]].tolist()
            assert len(own) == len(want)
            for a, b in zip(want, own):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def vocabulary():
    import public_tokenizers as P
    return P, bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_the_reference_library():
    import tiktoken
    P, v = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    letters = "aAbst'remvld  \n\t19é²½ñ…!?.,'’中文 　\x1c\x85😀́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "   ", "a" * 700, "!!" * 400, " " * 300, "don't we're I'll 'twas x'S ''s '", None]
    texts += ["a" + chr(c) + "b1" + chr(c) + " " + chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for cache in (1_000_000, 50):
        e = bpe.Encoder(v, cache_size=cache)
        for p in arrays.text_pieces(pa.array(texts, pa.string()), max_bytes=20_000):
            ids, offs = e.encode(p)
            back, _ = e.decode(ids, offs)
            assert back.tobytes() == p.data.tobytes()
            for i in range(p.hi - p.lo):
                assert ids[offs[i]:offs[i + 1]].tolist() == enc.encode_ordinary(texts[p.lo + i] or "")
        texts = texts[:400]


@pytest.mark.parametrize("width", [1, 3, 64])
def test_scan_of_transition_functions_equals_a_loop(width):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        state, want = bpe.AT_START, []
        for s in symbols:
            want.append(state)
            state = bpe.NEXT[s, state]
        assert bpe.scan(symbols, width).tolist() == want if n else True


def bag(t):
    w = WORD.findall(lower(t))
    return collections.Counter(zip(w, w[1:])) if len(w) > 1 else collections.Counter(w)


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    a = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    b = [t[:len(t) // 2] + " " + rng.choice(a)[:len(t) // 2] for t in a]
    x, y = (cws.fingerprints_of([t.encode() for t in s]) for s in (a, b))
    got = cws.likeness(x, y)
    true = np.array([sum((bag(s) & bag(t)).values()) / sum((bag(s) | bag(t)).values()) for s, t in zip(a, b)])
    assert abs((got - true).mean()) < 0.01
    assert np.sqrt(((got - true) ** 2).mean()) < 1.3 * np.sqrt((true * (1 - true) / cws.SAMPLES).mean())


def test_fingerprints_of_equal_and_empty_texts():
    f = cws.fingerprints_of([b"one two three", b"", b"ONE  two\nthree", b" \t ", b"x"])
    t = cws.to_text(f)
    assert t[0] == t[2] and len(t[0]) == 4 * cws.SAMPLES and t[1] == t[3] == "" and t[4]
    assert cws.likeness(f[1:2], f[3:4])[0] == 1.0 and cws.likeness(f[1:2], f[:1])[0] == 0.0
    assert cws.edited_text("abcde", "xy") == "abcxy" and cws.edited_text("abcde", "z") == "abcz"
    assert cws.edited_text("", "q") == "" and cws.edited_text("a", "q") == "a"


def test_heavier_terms_follow_the_weights():
    a, b = b"a " * 30 + b"b", b"a " * 10 + b"b " * 20 + b"b"
    true = sum((bag(a.decode()) & bag(b.decode())).values()) / sum((bag(a.decode()) | bag(b.decode())).values())
    # the same weights on many renamed pairs of terms
    left = [a.replace(b"a", b"p%d" % i).replace(b"b", b"q%d" % i) for i in range(400)]
    right = [b.replace(b"a", b"p%d" % i).replace(b"b", b"q%d" % i) for i in range(400)]
    got = cws.likeness(cws.fingerprints_of(left), cws.fingerprints_of(right)).mean()
    assert abs(got - true) < 0.02


def test_mixture_splits_a_two_language_text():
    lik = np.log(np.array([[0.9, 0.1, 0.01]] * 60 + [[0.1, 0.9, 0.01]] * 40 + [[0.9, 0.1, 0.01]] * 3))
    share = language.mixtures(lik, np.array([0, 100, 100, 103]))
    assert abs(share[0, 0] - 0.6) < 0.08 and share[0, 2] == 0
    assert share[1].sum() == 0 and share[2, 0] == 1.0


def test_letter_words_never_cross_texts():
    p = next(arrays.text_pieces(pa.array(["ab", "cd ef", "12", "", "É"])))
    w = language.letter_words(p)
    assert np.diff(w.offsets).tolist() == [1, 2, 0, 0, 1]
    q = next(arrays.text_pieces(pa.array(["é"])))
    assert language.letter_words(q).cells.tolist() == w.cells[-1:].tolist()


def test_preferences_rank_the_better_rows_first():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400) > 0).astype(int)
    m = quality.fit_pairs(x, y)
    s = m.score(x)
    assert ((s >= quality.CUT) == (y == 1)).mean() > 0.95
    assert (quality.fit_pairs(x, np.ones(400)).score(x) == 0.5).all()


def test_quality_features_of_odd_texts():
    texts = ["", None, " ", "A B A", "x\nx\ny", "ÀÉ", "!" * 5000]
    f = quality.features(next(arrays.text_pieces(pa.array(texts, pa.string()))))
    assert f.shape == (7, len(quality.FEATURES)) and np.isfinite(f).all()
    assert (f[0] == f[1]).all()
    assert abs(f[3, 0] - 3 / 5) < 1e-12 and abs(f[4, 5] - 2 / 3) < 1e-12


def test_net_finds_planted_words_in_unseen_texts():
    rng = np.random.default_rng(4)
    filler = rng.integers(0, 1 << 36, 3000)
    bad = rng.integers(0, 1 << 36, 6)

    def text(label):
        w = rng.choice(filler, rng.integers(20, 200))
        if label:
            w[rng.integers(len(w))] = rng.choice(bad)
        return w
    y = rng.integers(0, 2, 700)
    net = toxicity.train([text(v) for v in y], y.astype(np.float32))
    t = rng.integers(0, 2, 300)
    codes = [text(v) for v in t]
    z = toxicity.logits(net, np.concatenate(codes), np.concatenate(([0], np.cumsum([len(c) for c in codes]))))
    cut = toxicity.best_threshold(z, t, 2.0)
    assert ((z > cut) == (t == 1)).mean() > 0.97
    empty = toxicity.logits(net, np.zeros(0, np.int64), np.array([0, 0]))
    assert empty.shape == (1,) and empty[0] < cut


def test_signature_keys_find_every_pair_within_the_distance():
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    other = sig.copy()
    for i in range(300):
        at = rng.choice(neardup.SYMBOLS, neardup.MAX_DISTANCE, replace=False)
        other[i, at] ^= np.uint16(1)
    a, b = neardup.chunk_keys(sig), neardup.chunk_keys(other)
    shared = a == b
    assert shared.any(axis=1).all()
    assert (neardup._first_shared_key(sig, other) == shared.argmax(axis=1)).all()


def test_cell_bound_never_loses_a_link():
    rng = np.random.default_rng(8)
    for _ in range(200):
        base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        x, y = np.unique(base[:rng.integers(200, 300)]), np.unique(base[rng.integers(0, 60):])
        cells = [np.minimum(np.bincount((s & np.uint64(neardup.CELLS - 1)).astype(int), minlength=neardup.CELLS),
                            neardup.FULL_CELL).astype(np.uint8)[None] for s in (x, y)]
        if neardup.linked(x, y, 75):
            assert neardup._may_link(*cells, np.array([len(x)]), np.array([len(y)]), 75)[0]
    assert not neardup.linked(np.zeros(0, np.uint64), np.zeros(0, np.uint64), 75)
    assert neardup.linked(np.arange(3, dtype=np.uint64), np.arange(4, dtype=np.uint64), 75)


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    x = np.repeat(centres, 64, axis=0) + 0.1 * rng.normal(size=(512, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = ann.graph(x, 8)
    part = ann.balanced_parts(near, 3)
    assert np.bincount(part, minlength=8).tolist() == [64] * 8
    assert (part[near] == part[:, None]).mean() > 0.8
    assert ann.balanced_parts(ann.graph(x[:7], 3), 1).sum() in (3, 4)


def test_raking_meets_the_marginals_it_can_meet():
    cells = [(s, l, t, n) for s, a in (("src0", 500), ("*", 900)) for l, b in (("en", 3), ("de", 2)) for t, c in
             (("prose", 5), ("table", 1)) for n in [a * b * c]]
    targets = {"source": {"src0": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.7, "table": 0.3}}
    p = raking.rake(cells, targets, 0.3)
    kept = {c[:3]: c[3] * p[c[:3]] for c in cells}
    total = 0.3 * sum(c[3] for c in cells)
    assert all(0 <= x <= 1 for x in p.values())
    assert abs(sum(v for k, v in kept.items() if k[0] == "src0") / total - 0.5) < 1e-3
    assert abs(sum(v for k, v in kept.items() if k[2] == "table") / total - 0.3) < 1e-3
    assert raking.rake([], targets, 0.3) == {}
    assert raking.rake([("a", "b", "c", 0)], targets, 0.3) == {("a", "b", "c"): 0.0}
