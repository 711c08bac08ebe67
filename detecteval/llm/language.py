"""Language of a document as a mixture (operator 3).

Training counts letter trigrams (with word ends as blanks, in lower case) for
each language. A document is a mixture of languages: each of its words is
drawn from one of them, with the word's likelihood the product of its trigram
probabilities. *Expectation-maximisation* estimates the language proportions
of every document of a batch at once. The language set is chosen by penalised
likelihood: the language of the smallest proportion leaves as long as the
log-likelihood falls by less than ``penalty`` times the logarithm of the number
of words. The prediction is the language of the largest proportion, which is
also the score.

The trigram model is fitted on a bounded sample of labelled rows, ``per_language``
rows of each language, chosen by hash, for the ``most_languages`` values of ``lang``
with the most rows (ties by name); a dirty column of more values has no more than
that in the model. Prediction reads every whole text.

Defined cases: null text or text without letters is ``und`` with score 0; ties
go to the language first in order; without labelled rows all texts are ``und``.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import PIECE_BYTES, U64, Piece, codepoints, sum_cells, text_pieces
from .bpe import LETTER, classes_of

CELLS = 1 << 15
UNKNOWN = "und"


class LetterWords(NamedTuple):
    """Trigram cell of each letter; starts[i]: first letter of word i;
    offsets[d]: first word of text d."""
    cells: np.ndarray
    starts: np.ndarray
    offsets: np.ndarray


def letter_words(p: Piece) -> LetterWords:
    """Words (runs of letters) of a piece as trigram cells."""
    cps, offs = codepoints(p)
    low = _lower(cps)
    n = len(low)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = classes_of(cps) == LETTER
    char = np.zeros(n + 2, np.uint64)
    char[1:-1] = np.where(letter[1:-1], low, 0)
    edge = np.zeros(n + 2, bool)
    edge[offs + 1] = True  # a text starts here: nothing before it counts
    at = np.flatnonzero(letter)
    before = np.where(edge[at], U64(0), char[at - 1])
    after = np.where(edge[np.minimum(at + 1, n + 1)], U64(0), char[np.minimum(at + 1, n + 1)])
    h = (before * U64(0x9E3779B97F4A7C15) ^ char[at] * U64(0xC2B2AE3D27D4EB4F)) + after * U64(0x165667B19E3779F9)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    first = np.flatnonzero(~letter[at - 1] | edge[at])
    return LetterWords((h >> U64(49)).astype(np.int64), first, np.searchsorted(at[first], offs + 1))


_low: np.ndarray | None = None


def _lower(cps: np.ndarray) -> np.ndarray:
    """Lower case by code point (those with a single lower-case form)."""
    global _low
    if _low is None:
        _low = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1E944):
            s = chr(c).lower()
            if len(s) == 1:
                _low[c] = ord(s)
    return _low[cps]


class Model(NamedTuple):
    languages: list
    log_p: np.ndarray  # [CELLS, languages]


def fit(docs: DataFrame, text: str, lang: str, key: str, where: Column | None = None,
        per_language: int | None = 3000, smoothing: float = 0.5, most_languages: int = 256) -> Model:
    """Trigram model of the labelled rows that meet ``where``. About
    ``per_language`` rows of each language are read (all, if there are fewer, or with None);
    the counts, ``most_languages`` x 32,768 cells at most, come to the driver."""
    rows = docs.select(docs[key].cast("string").alias("k"), docs[text].alias("text"), docs[lang].alias("lang"))
    rows = (rows if where is None else docs.where(where).select(
        F.col(key).cast("string").alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((CELLS, 0), np.float32))
    if per_language is None:
        chosen = rows.where(F.col("lang").isin(languages)).select("lang", "text")
    else:
        shares = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, per_language / sizes[l]))])
        draw = F.pmod(F.xxhash64("k", F.lit("language sample")), F.lit(1_000_003)) / 1_000_003.0
        chosen = rows.where(draw < shares[F.col("lang")]).select("lang", "text")
    index = {l: i for i, l in enumerate(languages)}

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for p in text_pieces(batch.column(1)):
                w = letter_words(p)
                per_word = np.diff(np.append(w.starts, len(w.cells)))
                doc = np.repeat(np.repeat(np.arange(p.hi - p.lo), np.diff(w.offsets)), per_word)
                for l in set(names[p.lo:p.hi].tolist()):
                    mine = (names[p.lo:p.hi] == l)[doc]
                    totals[l] = totals.get(l, 0) + np.bincount(w.cells[mine], minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([index[l] for l in totals], pa.int64()),
                                          pa.array([x.astype(float).tobytes() for x in totals.values()], pa.binary())],
                                         names=["cell", "data"])

    n = np.full((CELLS, len(languages)), smoothing)
    for r in sum_cells(chosen.mapInArrow(count, "cell long, data binary")).collect():  # one row of counts a language
        n[:, r["cell"]] += np.frombuffer(r["data"])
    return Model(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def word_likelihoods(model: Model, w: LetterWords) -> np.ndarray:
    """Log-likelihood of each word in each language, [words, languages]."""
    if not len(w.starts):
        return np.zeros((0, len(model.languages)), np.float32)
    return np.add.reduceat(model.log_p[w.cells], w.starts, axis=0)


def mixtures(log_lik: np.ndarray, offsets: np.ndarray, rounds: int = 8, later_rounds: int = 4,
             penalty: float = 0.5) -> np.ndarray:
    """Language proportions of each text, [texts, languages]; rows of texts
    without words are zero. Texts that are done leave the arrays."""
    docs, langs = len(offsets) - 1, log_lik.shape[1]
    share = np.zeros((docs, langs))
    count = np.diff(offsets)
    full = np.flatnonzero(count)
    if not len(full) or not langs:
        return share
    lik = np.exp(log_lik - log_lik.max(axis=1, keepdims=True))

    def improve(which, pi, times):
        """EM on some texts; also the log-likelihood, up to a constant of the text."""
        rows = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in which])
        sizes = count[which]
        starts = np.cumsum(sizes) - sizes
        own, doc = lik[rows], np.repeat(np.arange(len(which)), sizes)
        for _ in range(times):
            joint = own * pi[doc]
            total = np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
            pi = np.add.reduceat(joint / total, starts, axis=0) / sizes[:, None]
        total = np.maximum((own * pi[doc]).sum(axis=1), 1e-30)
        return pi, np.add.reduceat(np.log(total), starts)

    pi, fitted = improve(full, np.full((len(full), langs), 1.0 / langs), rounds)
    active = np.ones((len(full), langs), bool)
    going = np.arange(len(full))
    for _ in range(langs - 1):
        cand = np.where(active[going], pi[going], np.inf)
        drop = cand.argmin(axis=1)
        trial = pi[going].copy()
        trial[np.arange(len(going)), drop] = 0
        trial = np.maximum(trial, 1e-6 * active[going])
        trial[np.arange(len(going)), drop] = 0
        trial /= trial.sum(axis=1, keepdims=True)
        trial, value = improve(full[going], trial, later_rounds)
        better = value >= fitted[going] - penalty * np.log(count[full[going]])
        going, trial, value, drop = going[better], trial[better], value[better], drop[better]
        if not len(going):
            break
        pi[going], fitted[going] = trial, value
        active[going, drop] = False
    share[full] = pi
    return share


def predict_piece(model: Model, p: Piece) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and proportions of each text of a piece."""
    n = p.hi - p.lo
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.zeros((n, 0))
    w = letter_words(p)
    share = mixtures(word_likelihoods(model, w), w.offsets)
    some = np.diff(w.offsets) > 0
    best = share.argmax(axis=1)
    names = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
    return names, np.where(some, share.max(axis=1), 0.0), share


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least: float = 0.05) -> DataFrame:
    """doc_id, lang_pred, score, and ``languages``: the selected languages of at
    least ``least`` with their proportions, the largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32,768 cells x languages

    def run(batches):
        model = shared.value
        piece = PIECE_BYTES * 8 // max(8, len(model.languages))  # words x languages at a time
        for batch in batches:
            for p in text_pieces(batch.column(1), piece):
                names, score, share = predict_piece(model, p)
                sets = [[{"lang": model.languages[j], "share": float(row[j])}
                         for j in np.argsort(-row, kind="stable") if row[j] >= least] for row in share]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.lo, p.hi - p.lo), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)),
                     pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text]).mapInArrow(
        run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
