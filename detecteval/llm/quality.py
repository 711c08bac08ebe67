"""Quality of a document (operator 6): Bradley-Terry ranking from preferences.

Pairs of a good and a bad labelled document are preferences. The model gives
each document a strength, linear in features of its whole text, and the
probability that one beats another is the logistic function of the difference;
the weights minimise the logistic loss on *feature differences* over every pair
of a good and a bad training row. The cut is the strength at which all training
rows are split best; the score is the logistic function of the strength, shifted so that
the cut has the score ``CUT``.

Features (DataFrame functions, whole text): shares of capitals, digits, signs
and white space, distinct words per word, distinct lines per line, mean word
length, log length, the share of immediately repeated words. Fit and scores cover every row.

Defined cases: an empty or null text has the features of "", and a score like
any other; without labels of both kinds every score is 0.5.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written
from .arrays import Piece, char_counts, released, split_words, text_pieces

CUT = 0.3
FEATURES = ["capitals", "digits", "signs", "spaces", "distinct_words", "distinct_lines", "word_length", "log_chars",
            "repeats"]


def _mask(ranges) -> np.ndarray:
    m = np.zeros(256, bool)
    for a, b in ranges:
        m[a:b + 1] = True
    return m


_CAPITAL, _DIGIT, _SPACES = _mask([(65, 90)]), _mask([(48, 57)]), _mask([(9, 13), (32, 32)])
#: ASCII signs other than the common marks . , ' - ( ) : ; ? and quotes.
_SIGN = _mask([(33, 33), (35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126)])
_NEWLINE = _mask([(10, 10)])


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct values of each text."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = np.sort((text << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.append(True, key[1:] != key[:-1])[:len(key)]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=len(offsets) - 1)


def features(p: Piece) -> np.ndarray:
    """[texts, features] of a piece."""
    n = p.hi - p.lo
    chars = char_counts(p)
    over = np.maximum(chars, 1)

    def share(mask):
        total = np.concatenate(([0], np.cumsum(mask[p.data], dtype=np.int64)))
        return (total[p.offsets[1:]] - total[p.offsets[:-1]]) / over

    words = split_words(p.data, p.offsets)
    lines = split_words(p.data, p.offsets, _NEWLINE[p.data])
    count = np.diff(words.offsets)
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    inner = words.offsets[:-1][count > 0]
    same[inner] = False
    repeated = np.concatenate(([0], np.cumsum(same)))
    letters = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    length = letters[words.offsets[1:]] - letters[words.offsets[:-1]]
    many = np.maximum(count, 1)
    spread = np.where(count > 0, _distinct(words.hashes, words.offsets), 1) / many ** 0.9
    lines_of = np.diff(lines.offsets)
    return np.stack([share(_CAPITAL), share(_DIGIT), share(_SIGN), share(_SPACES), spread,
                     np.where(lines_of > 0, _distinct(lines.hashes, lines.offsets), 1) / np.maximum(lines_of, 1),
                     np.minimum(length / many, 50) / 10, np.log1p(chars) / 10,
                     (repeated[words.offsets[1:]] - repeated[words.offsets[:-1]]) / many], axis=1).reshape(n, -1)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float       # the strength that gets the score CUT
    spread: float
    known: bool

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        s = ((x - self.mean) / self.scale * self.weights).sum(axis=1)  # the same for equal rows wherever they stand
        z = (s - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, steps: int = 300, l2: float = 1e-3,
              seed: int = 6) -> Model:
    """Bradley-Terry weights from ``pairs`` preferences of a good row over a bad one."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, False)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(steps):  # Newton steps, damped; the loss is convex
        q = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = -(diff * q[:, None]).mean(axis=0) + l2 * w
        hess = (diff * (q * (1 - q))[:, None]).T @ diff / pairs + l2 * np.eye(width)
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    strength = z @ w
    # the quantile that splits the training rows best (fewest errors, each kind by its share)
    grid = np.unique(np.quantile(strength, np.linspace(0.001, 0.999, 999)))
    order = np.sort(strength[good]), np.sort(strength[bad])
    lost = np.searchsorted(order[0], grid) / len(good)
    passed = 1 - np.searchsorted(order[1], grid) / len(bad)
    loss = lost + passed
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return Model(mean, scale, w, float(grid[best[len(best) // 2]]), float(max(strength.std(), 1e-6) / 2), True)


def _cells(table: DataFrame, model: Model, reach: float, cells: int, moments: bool) -> dict[tuple[int, int], np.ndarray]:
    """{(label, cell): sums} over all rows, in even cells of the strength between -reach
    and reach (the outer ones take what lies beyond): the number of rows and, with
    ``moments``, the sums of the standardised features and of their products."""
    width = len(FEATURES)

    def local(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            z = (x - model.mean) / model.scale
            cell = np.clip(np.floor(((z * model.weights).sum(axis=1) + reach) * (cells / (2 * reach))), 0, cells - 1)
            data = np.ones((len(y), 1))
            if moments:
                data = np.concatenate((data, z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)), axis=1)
            found, back = np.unique(y * cells + cell.astype(np.int64), return_inverse=True)
            sums = np.zeros((len(found), data.shape[1]))
            np.add.at(sums, back, data)
            for k, part in zip(found.tolist(), sums):
                total[k] = total[k] + part if k in total else part
        yield from _sums(total)

    def merged(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data)
                total[k] = total[k] + part if k in total else part
        yield from _sums(total)

    def _sums(total):
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()),
                                          pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["cell", "data"])
    got = (table.mapInArrow(local, "cell long, data binary").repartition("cell")
           .mapInArrow(merged, "cell long, data binary").collect())  # two labels times ``cells`` rows at most
    return {divmod(r["cell"], cells): np.frombuffer(r["data"]) for r in got}


def fit_all_pairs(table: DataFrame, cells: int = 1024, fine: int = 65_536, steps: int = 40, l2: float = 1e-3) -> Model:
    """Bradley-Terry weights from *every* pair of a good row and a bad one of ``table``
    (y, x), in work linear in the rows.

    The loss of a pair hangs on the difference of two strengths, so rows of one label
    and one narrow cell of the strength stand together by their mean strength: a Newton
    step is one job that adds up each cell's rows, features and products of features,
    and arithmetic over pairs of cells on the driver. The cut is the edge of ``fine``
    even cells that splits all rows best."""
    width = len(FEATURES)
    blank = Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, False)
    x = F.col("x")
    row = table.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), *[F.avg(x[i]) for i in range(width)],
                    *[F.stddev_pop(x[i]) for i in range(width)]).first()
    good, bad = row[0], row[1]
    if not good or not bad:
        return blank
    model = blank._replace(mean=np.array(row[2:2 + width], float),
                           scale=np.maximum(np.array(row[2 + width:], float), 1e-6), known=True)
    w, spread, cov = np.zeros(width), 0.0, None
    for _ in range(steps):  # Newton steps, damped; the loss is convex
        got = _cells(table, model._replace(weights=w), max(8 * spread, 1e-6), cells, True)
        n, total, square = [], [], []
        for label in (1, 0):
            data = np.array([v for (y, _), v in sorted(got.items(), key=lambda kv: kv[0]) if y == label])
            n.append(data[:, 0])
            total.append(data[:, 1:1 + width])
            square.append(data[:, 1 + width:].reshape(-1, width, width))
        if cov is None:
            cov = (square[0].sum(axis=0) + square[1].sum(axis=0)) / (good + bad)
        s = [(t / m[:, None]) @ w for t, m in zip(total, n)]
        q = 1 / (1 + np.exp(np.clip(s[0][:, None] - s[1][None, :], -40, 40)))
        c = q * (1 - q)
        grad = -((q @ n[1]) @ total[0] - (n[0] @ q) @ total[1]) / (good * bad) + l2 * w
        cross = total[0].T @ c @ total[1]
        hess = (np.einsum("i,ijk->jk", c @ n[1], square[0]) + np.einsum("i,ijk->jk", n[0] @ c, square[1])
                - cross - cross.T) / (good * bad) + l2 * np.eye(width)
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        spread = float(np.sqrt(max(w @ cov @ w, 0.0)))
        if np.abs(move).max() < 1e-5:
            break
    reach = max(8 * spread, 1e-6)
    model = model._replace(weights=w, spread=max(spread, 1e-6) / 2)
    counts = np.zeros((2, fine))
    for (y, cell), data in _cells(table, model, reach, fine, False).items():
        counts[y, cell] = data[0]
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(counts, axis=1)), axis=1)[:, :-1]
    loss = below[1] / good + 1 - below[0] / bad  # good rows under the edge and bad ones from it on, by their shares
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return model._replace(cut=float(-reach + best[len(best) // 2] * (2 * reach / fine)))


def fit(docs: DataFrame, labels: DataFrame, where=None, text: str = "text", key: str = "doc_id",
        label: str = "quality") -> Model:
    """Model of every labelled row, all pairs of a good and a bad one. A document with
    both labels counts with each of them, a repeated label once."""
    own = labels.select(labels[key].cast("long").alias("k"), labels[label].cast("int").alias("y")).where("y in (0, 1)")
    own = (own if where is None else own.where(where("k"))).distinct()
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("text")).where("k is not null")
    rows = rows if where is None else rows.where(where("k"))

    def run(batches):
        for batch in batches:
            for p in text_pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.lo, p.hi - p.lo),
                                                  pa.array(features(p).tolist(), pa.list_(pa.float64()))], names=["k", "x"])

    # features meet the labels, not texts: a row takes the same few bytes to the join however long its text is
    table = written(rows.mapInArrow(released(run), "k long, x array<double>").join(own, "k").select("y", "x"))
    model = fit_all_pairs(table)
    discard(table)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """__id and __score of every row, and the columns named in ``carry``."""
    carry = carry or []
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    own = docs.select(docs[key].cast("long").alias("__id"), docs[text].alias("__text"), *[docs[c] for c in carry])

    def run(batches):
        for batch in batches:
            for p in text_pieces(batch.column(1)):
                n = p.hi - p.lo
                cols = [batch.column(0).slice(p.lo, n), pa.array(model.score(features(p)))]
                cols += [batch.column(2 + i).slice(p.lo, n) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "__score", *carry])

    return own.mapInArrow(released(run), "__id long, __score double" + kinds)
