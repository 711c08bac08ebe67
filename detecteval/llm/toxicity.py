"""Toxicity of a document (operator 7): a convolutional text classifier.

Words (ASCII-lowered runs of letters and digits) get vectors by hashing: the
sum of a row from each of two tables, so that two words rarely share both. The
first component of a row starts at the log-odds of its cell to occur in a toxic
text, and the first filter at that component; all else starts at random. Filters of widths 1, 2 and 3 run over the whole text, each filter's maximum
goes to one logistic unit. Forward and backward passes are numpy.

Every labelled row counts. Three quarters of them, told by their id, give the log-odds and
the weights: in each of a few rounds every task starts from the shared net, learns by Adagrad
on the rows of its own partition and hands back how far it moved the cells that it touched; a
cell's moves are averaged over its touches, so the net is as large as its tables whatever the
rows. The other quarter calibrates a threshold for each language (counts of outputs in cells
of 1 / ``GRID``), detected from the text by the trigram model of ``language``, itself
counted on all rows; a language with few such rows takes the threshold of all. The score is
the logistic function of the output, shifted so that the threshold of the text's language has
the score ``CUT``.

Defined cases: a null or empty text has the score of a text without words;
without labels of both kinds all scores are 0.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written
from . import language
from .arrays import PIECE_BYTES, U64, Piece, give_back_memory, lower_ascii, released, split_words, sum_cells, text_pieces

CUT = 0.7
BITS, WIDTH, FILTERS, SIZES = 18, 8, 8, (1, 2, 3)
BLOCK = 1 << 14            # table cells that travel together
GRID, FARTHEST = 512, 40   # outputs are counted in cells of 1 / GRID, those beyond FARTHEST in the outer ones
_BREAK = np.ones(256, bool)
for _a, _b in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _BREAK[_a:_b + 1] = False


def word_codes(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """A code of 2 * BITS bits of each word, and the offsets of the texts in them."""
    data = lower_ascii(p.data)
    words = split_words(data, p.offsets, _BREAK[data])
    return (words.hashes >> U64(64 - 2 * BITS)).astype(np.int64), words.offsets


def cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word in the two tables."""
    return codes >> BITS, codes & ((1 << BITS) - 1)


class Net(NamedTuple):
    tables: np.ndarray   # [2, 2^BITS, WIDTH]
    taps: list           # for each width: [width, WIDTH, FILTERS]
    bias: np.ndarray     # [widths * FILTERS]
    out: np.ndarray
    out_bias: np.ndarray

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b = cells(codes)
        return self.tables[0][a] + self.tables[1][b]


def _texts_with(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[2, 2^BITS]: how many of the texts hold a table cell."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) << BITS
    return np.stack([np.bincount(np.unique(text | half) & ((1 << BITS) - 1), minlength=1 << BITS) for half in cells(codes)])


def _log_odds(seen: np.ndarray, totals) -> np.ndarray:
    """[2, 2^BITS]: smoothed log-odds of a table cell to occur in a positive text, from the
    texts of either label that hold it (``seen``: [label, 2, 2^BITS]) and their number."""
    out = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    return out - np.log((totals[0] + 1) / (totals[1] + 1))  # a cell never seen has 0


def _new_net(rng, seen: np.ndarray, totals) -> Net:
    n = len(SIZES) * FILTERS
    tables = rng.normal(0, 0.05, (2, 1 << BITS, WIDTH)).astype(np.float32)
    tables[:, :, 0] = 0.25 * _log_odds(seen, totals)
    taps = [rng.normal(0, 0.2, (w, WIDTH, FILTERS)).astype(np.float32) for w in SIZES]
    taps[0][0, :, 0] = np.eye(WIDTH)[0]
    out = rng.normal(0, 0.1, n).astype(np.float32)
    out[0] = 3.0
    return Net(tables, taps, np.zeros(n, np.float32), out, np.full(1, -4.0, np.float32))


def _arrays(net: Net) -> tuple:
    """Tables first, then the small parameters."""
    return (net.tables, *net.taps, net.bias, net.out, net.out_bias)


def _first_sums(net: Net) -> list[np.ndarray]:
    return [np.full(a.shape, 1e-2, np.float32) for a in _arrays(net)]


def _places(offsets: np.ndarray) -> np.ndarray:
    """Positions of the words when each text is followed by blank words."""
    count = np.diff(offsets)
    return np.arange(offsets[-1]) + np.repeat(np.arange(len(count)), count) * (max(SIZES) - 1)


def _pool(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, starts, axis=0)


def logits(net: Net, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Output of each text; filters are applied to the distinct words once."""
    docs = len(offsets) - 1
    pooled = np.zeros((docs, len(SIZES) * FILTERS), np.float32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        distinct, back = np.unique(codes, return_inverse=True)
        vec = np.concatenate((net.vectors(distinct), np.zeros((1, WIDTH), np.float32)))
        place = _places(offsets)
        padded = np.full(len(codes) + docs * (max(SIZES) - 1), len(distinct), np.int64)
        padded[place] = back
        for s, w in enumerate(SIZES):
            total = 0
            for j in range(w):
                total = total + (vec @ net.taps[s][j])[padded[place + j]]
            pooled[full, s * FILTERS:(s + 1) * FILTERS] = _pool(total, offsets[full])
    return np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias


def learn(net: Net, sums: list, codes: list[np.ndarray], y: np.ndarray, weight: np.ndarray, order: np.ndarray,
          batch: int = 64, rate: float = 0.05, hits: np.ndarray | None = None) -> None:
    """Adagrad steps over the texts in ``order``, in place. ``hits`` counts the steps that touch a table cell."""
    def step(param, acc, grad, at=...):
        acc[at] += grad * grad
        param[at] -= rate * grad / np.sqrt(acc[at])

    for lo in range(0, len(order), batch):
        rows = order[lo:lo + batch]
        flat = np.concatenate([codes[r] for r in rows])
        offsets = np.concatenate(([0], np.cumsum([len(codes[r]) for r in rows])))
        place = _places(offsets)
        docs = len(rows)
        x = np.zeros((len(flat) + docs * (max(SIZES) - 1), WIDTH), np.float32)
        x[place] = net.vectors(flat)
        pooled = np.empty((docs, len(net.bias)), np.float32)
        where = np.empty((docs, len(net.bias)), np.int64)
        for s, w in enumerate(SIZES):
            total = 0
            for j in range(w):
                total = total + x[place + j] @ net.taps[s][j]
            own = slice(s * FILTERS, (s + 1) * FILTERS)
            pooled[:, own] = _pool(total, offsets[:-1])
            for d in range(docs):
                where[d, own] = total[offsets[d]:offsets[d + 1]].argmax(axis=0) + offsets[d]
        hidden = np.maximum(pooled + net.bias, 0)
        z = hidden @ net.out + net.out_bias
        err = ((1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / docs).astype(np.float32)
        back = err[:, None] * net.out * (hidden > 0)
        tap_grads = []
        at_all, grad_all = [], []
        for s, w in enumerate(SIZES):
            own = slice(s * FILTERS, (s + 1) * FILTERS)
            at = place[where[:, own]]  # [docs, filters]
            g = np.empty_like(net.taps[s])
            for j in range(w):
                g[j] = np.einsum("dfk,df->kf", x[at + j], back[:, own])
                at_all.append((at + j).reshape(-1))
                grad_all.append((back[:, own][:, :, None] * net.taps[s][j].T[None]).reshape(-1, WIDTH))
            tap_grads.append(g)
        code_at = np.full(len(x), -1, np.int64)
        code_at[place] = flat
        at, grad = np.concatenate(at_all), np.concatenate(grad_all)
        own = code_at[at] >= 0
        word, grad = code_at[at][own], grad[own]
        for half, cell in enumerate(cells(word)):
            uniq, back_at = np.unique(cell, return_inverse=True)
            g = np.zeros((len(uniq), WIDTH), np.float32)
            np.add.at(g, back_at, grad)
            step(net.tables[half], sums[0][half], g, uniq)
            if hits is not None:
                hits[half][uniq] += 1
        for k, g in enumerate((*tap_grads, back.sum(axis=0), hidden.T @ err, np.array([err.sum()], np.float32))):
            step(_arrays(net)[k + 1], sums[k + 1], g)


def _weights(y: np.ndarray, share: float) -> np.ndarray:
    """Both labels weigh the same; ``share`` of all rows are positive."""
    return np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))


def train(codes: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05,
          seed: int = 7) -> Net:
    """Fit the net to texts in memory, given as word codes (none empty) and labels 0/1."""
    rng = np.random.default_rng(seed)
    totals = [(y == v).sum() for v in (0, 1)]
    seen = np.stack([sum((_texts_with(c, np.array([0, len(c)])) for c, l in zip(codes, y) if l == v),
                         np.zeros((2, 1 << BITS), np.int64)) for v in (0, 1)])
    net = _new_net(rng, seen, totals)
    sums, weight = _first_sums(net), _weights(y, y.mean())
    for _ in range(epochs):
        learn(net, sums, codes, y, weight, rng.permutation(len(codes)), batch, rate)
    return net


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), np.int64) for b in column]  # views, not copies


def train_all(table: DataFrame, totals, rounds: int = 3, passes: int = 2, chunk: int = 4096, seed: int = 7) -> Net:
    """Fit the net to every row of ``table`` (y int, words binary; none empty), ``totals`` of each label."""
    spark = table.sparkSession
    table = table.select("y", "words")

    def count(batches):
        seen = np.zeros((2, 2, 1 << BITS))
        for batch in batches:
            y, codes = batch.column(0).to_numpy(), _words(batch.column(1))
            for v in (0, 1):
                own = [c for c, l in zip(codes, y) if l == v]
                for lo in range(0, len(own), 256):
                    part = own[lo:lo + 256]
                    seen[v] += _texts_with(np.concatenate(part), np.concatenate(([0], np.cumsum([len(c) for c in part]))))
        blocks = seen.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[i].tobytes() for i in some], pa.binary())],
                                         names=["cell", "data"])
    seen = np.zeros((4 << BITS) // BLOCK * BLOCK).reshape(-1, BLOCK)
    for r in sum_cells(table.mapInArrow(released(count), "cell long, data binary")).collect():  # four tables of counts
        seen[r["cell"]] = np.frombuffer(r["data"])
    net = _new_net(np.random.default_rng(seed), seen.reshape(2, 2, -1), totals)
    sums = _first_sums(net)
    share = totals[1] / (totals[0] + totals[1])
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((net, sums))  # twice the net's fixed size
        moves = _moves(table, shared, share, passes, chunk, [seed, turn])
        for batch in moves.toArrow().to_batches():  # each touched cell once: the net's size at most
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _move(net, sums, block, data.as_buffer())
        shared.destroy()
    return net


_ENTRY = np.dtype([("at", np.uint16), ("hits", np.float32), ("net", np.float16, WIDTH), ("sums", np.float16, WIDTH)])
_MERGED = np.dtype([("at", np.uint16), ("net", np.float32, WIDTH), ("sums", np.float32, WIDTH)])
_SMALL = -1  # block of the small parameters: steps, then moves of values and of Adagrad's sums


def _moves(table: DataFrame, shared, share: float, passes: int, chunk: int, seed: list[int]) -> DataFrame:
    """(block, data): moves of the table cells, averaged over the steps that touched them, and
    those of the small parameters, over all steps, after one round of learning on every row."""
    def run(batches):
        first, first_sums = shared.value
        net = Net(first.tables.copy(), [a.copy() for a in first.taps], first.bias.copy(), first.out.copy(),
                  first.out_bias.copy())
        sums = [a.copy() for a in first_sums]
        hits = np.zeros((2, 1 << BITS), np.int32)
        rng = np.random.default_rng(seed)
        steps = 0

        def take(codes, y):
            for _ in range(passes):
                learn(net, sums, codes, y, _weights(y, share), rng.permutation(len(codes)), hits=hits)
            return passes * -(-len(codes) // 64)
        codes, y = [], []
        for batch in batches:
            codes += _words(batch.column(1))
            y += batch.column(0).to_pylist()
            while len(codes) >= chunk:
                steps += take(codes[:chunk], np.array(y[:chunk], np.float32))
                codes, y = codes[chunk:], y[chunk:]
        if codes:
            steps += take(codes, np.array(y, np.float32))
        if not steps:
            return
        part, out = TaskContext.get().partitionId(), []
        for block in range(2 * (1 << BITS) // BLOCK):
            half, lo = divmod(block * BLOCK, 1 << BITS)
            at = np.flatnonzero(hits[half, lo:lo + BLOCK])
            data = np.empty(len(at), _ENTRY)
            data["at"], data["hits"] = at, hits[half, lo + at]
            data["net"] = net.tables[half, lo + at] - first.tables[half, lo + at]
            data["sums"] = np.minimum(sums[0][half, lo + at] - first_sums[0][half, lo + at], 6e4)
            out.append((block, part, data.tobytes()))
        small = [np.concatenate([(x - z).astype(float).reshape(-1) for x, z in zip(a, b)])
                 for a, b in ((_arrays(net)[1:], _arrays(first)[1:]), (sums[1:], first_sums[1:]))]
        out.append((_SMALL, part, np.concatenate(([steps], *small)).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
                                          pa.array([r[2] for r in out], pa.binary())], names=["block", "part", "data"])

    def merged(batches):
        now, total = None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if block != now and total is not None:
                    yield closed(now, total)
                    total = None
                now = block
                if block == _SMALL:
                    data = np.frombuffer(data)
                    data = np.concatenate((data[:1], data[0] * data[1:]))
                    total = data if total is None else total + data
                    continue
                data = np.frombuffer(data, _ENTRY)
                if total is None:
                    total = np.zeros((BLOCK, 1 + 2 * WIDTH))
                total[data["at"]] += np.concatenate((np.ones((len(data), 1)), data["net"], data["sums"]), axis=1) * data["hits"][:, None]
        if total is not None:
            yield closed(now, total)

    def closed(block, total):
        if block == _SMALL:
            data = total[1:] / total[0]
        else:
            at = np.flatnonzero(total[:, 0])
            mean = total[at, 1:] / total[at, :1]
            data = np.empty(len(at), _MERGED)
            data["at"], data["net"], data["sums"] = at, mean[:, :WIDTH], mean[:, WIDTH:]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data.tobytes()], pa.binary())],
                                          names=["block", "data"])
    return (table.mapInArrow(released(run), "block int, part int, data binary").repartition("block")
            .sortWithinPartitions("block", "part").mapInArrow(released(merged), "block int, data binary"))


def _move(net: Net, sums: list, block: int, data) -> None:
    """Add the moves of one block, in place."""
    if block == _SMALL:
        data, at = np.frombuffer(data), 0
        for own in (_arrays(net)[1:], sums[1:]):
            for a in own:
                a += data[at:at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size
        return
    data = np.frombuffer(data, _MERGED)
    half, lo = divmod(block * BLOCK, 1 << BITS)
    at = lo + data["at"].astype(np.int64)
    net.tables[half, at] += data["net"]
    sums[0][half, at] += data["sums"]


class Model(NamedTuple):
    net: Net | None
    languages: language.Model
    thresholds: np.ndarray  # one for each language, and the last for unknown ones
    spread: float

    def score(self, p: Piece) -> np.ndarray:
        if self.net is None:
            return np.zeros(p.hi - p.lo)
        z = logits(self.net, *word_codes(p)) - self.thresholds[detect(self.languages, p)]
        return 1 / (1 + np.exp(-np.clip(z / self.spread + np.log(CUT / (1 - CUT)), -40, 40)))


def detect(model: language.Model, p: Piece) -> np.ndarray:
    """Number of the likeliest language of each text; the number after the last
    one for a text without letters."""
    n, langs = p.hi - p.lo, len(model.languages)
    out = np.full(n, langs)
    if not langs:
        return out
    w = language.letter_words(p)
    full = np.flatnonzero(np.diff(w.offsets))
    if len(full):
        first = w.starts[w.offsets[full]]
        out[full] = np.add.reduceat(model.log_p[w.cells], first, axis=0).argmax(axis=1)
    return out


def best_threshold(z: np.ndarray, y: np.ndarray, cost: float, n: np.ndarray | None = None) -> float:
    """Where caught positives minus ``cost`` times wrongly caught negatives, as
    shares, is largest; the middle of the widest such gap. Value i stands for ``n[i]`` rows."""
    n = np.ones(len(z)) if n is None else n
    order = np.argsort(z, kind="stable")
    z, y, n = z[order], y[order], n[order]
    cuts = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))

    def above(own):
        rows = np.concatenate(([0], np.cumsum(n[own])))
        return (rows[-1] - rows[np.searchsorted(z[own], cuts)]) / rows[-1]
    gain = above(y == 1) - cost * above(y == 0)
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    widths = np.diff(np.concatenate(([-np.inf], z, [np.inf])))[best]
    widths[~np.isfinite(widths)] = 0
    return float(cuts[best[widths.argmax()]])


def outputs(table: DataFrame, net: Net) -> tuple[np.ndarray, ...]:
    """Language, label, output (middle of its cell) and number of rows of every occupied cell
    of ``table`` (y int, l int, words binary; none empty)."""
    shared = table.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        total: dict[tuple, int] = {}
        for batch in batches:
            codes = _words(batch.column(2))
            for lo in range(0, len(codes), 512):
                part = codes[lo:lo + 512]
                z = logits(shared.value, np.concatenate(part), np.concatenate(([0], np.cumsum([len(c) for c in part]))))
                at = np.clip(np.floor(z * GRID), -FARTHEST * GRID, FARTHEST * GRID).astype(np.int64)
                own = zip(batch.column(1).slice(lo, 512).to_pylist(), batch.column(0).slice(lo, 512).to_pylist(), at.tolist())
                for one in own:
                    total[one] = total.get(one, 0) + 1
        found = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
                                         + [pa.array([total[f] for f in found], pa.int64())], names=["l", "y", "at", "n"])
    got = (table.select("y", "l", "words").mapInArrow(released(run), "l long, y long, at long, n long")
           .groupBy("l", "y", "at").agg(F.sum("n").alias("n")).orderBy("l", "y", "at").toArrow())
    shared.destroy()
    l, y, at, n = (got[c].to_numpy() for c in ("l", "y", "at", "n"))
    return l, y, (at + 0.5) / GRID, n


def encoded(docs: DataFrame, labels: DataFrame, languages: language.Model, where, text: str, key: str, label: str) -> DataFrame:
    """y, l (language), ``rest`` (only calibrates) and word codes of every labelled text with words. Texts
    travel to their labels in compressed form."""
    own = labels.select(labels[key].cast("long").alias("k"), labels[label].cast("int").alias("y")).where("y in (0, 1)")
    own = own.distinct()  # a repeated label is one label
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("text")).where("k is not null and text <> ''")
    rows = rows if where is None else rows.where(where("k"))
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def pack(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for p in text_pieces(batch.column(1)):
                n = p.hi - p.lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.lo, n), pa.array(np.diff(p.offsets)),
                     pa.array([codec.compress(p.text_bytes(i), asbytes=True) for i in range(n)], pa.binary())],
                    names=["k", "size", "packed"])

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            size, packed = batch.column(2), batch.column(3)
            for lo in range(0, batch.num_rows, 1024):
                texts = pa.array([codec.decompress(packed[i].as_buffer(), size[i].as_py(), asbytes=True)
                                  for i in range(lo, min(lo + 1024, batch.num_rows))], pa.large_binary()).cast(pa.large_string())
                for p in text_pieces(texts):
                    codes, offs = word_codes(p)
                    full = np.flatnonzero(np.diff(offs))
                    k = batch.column(0).slice(lo + p.lo, p.hi - p.lo).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[full]), batch.column(1).slice(lo + p.lo, p.hi - p.lo).take(pa.array(full)).cast(pa.int32()),
                         pa.array(detect(shared.value, p).astype(np.int32)[full]), pa.array(((np.abs(k) // 7) % 4 == 0)[full]),
                         pa.array([codes[offs[i]:offs[i + 1]].tobytes() for i in full], pa.binary())],
                        names=["k", "y", "l", "rest", "words"])
    joined = (rows.mapInArrow(released(pack), "k long, size long, packed binary")
              .join(own.hint("merge"), "k")  # labels grow with the texts: no broadcast, the same plan at every size
              .select("k", "y", "size", "packed"))
    return (joined.mapInArrow(released(run), "k long, y int, l int, rest boolean, words binary")
            .sortWithinPartitions("k", "y", "words").drop("k"))


def fit(docs: DataFrame, labels: DataFrame, where=None, text: str = "text", key: str = "doc_id", lang: str = "lang",
        label: str = "toxic", least: int = 60, cost: float = 4.0) -> Model:
    """Model of every labelled row; a document with both labels counts with each of them."""
    languages = language.fit(docs, text, lang, key, None if where is None else where(key), per_language=None)
    unfitted = Model(None, languages, np.zeros(len(languages.languages) + 1), 1.0)
    table = written(encoded(docs, labels, languages, where, text, key, label))
    sizes = {(r["rest"], r["y"]): r["n"] for r in table.groupBy("rest", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    use, rest = table.where("not rest"), table.where("rest")
    totals = [sizes.get((False, v), 0) for v in (0, 1)]
    if not min(totals):
        use, totals = table, [sizes.get((False, v), 0) + sizes.get((True, v), 0) for v in (0, 1)]
    if not min(totals):
        discard(table)
        return unfitted
    net = train_all(use, totals)
    l, y, z, n = outputs(rest if sizes.get((True, 0)) and sizes.get((True, 1)) else use, net)
    discard(table)
    thresholds = np.full(len(languages.languages) + 1, best_threshold(z, y, cost, n))
    for own in range(len(languages.languages)):
        mine = l == own
        if min(n[mine & (y == v)].sum() for v in (0, 1)) >= least:
            thresholds[own] = best_threshold(z[mine], y[mine], cost, n[mine])
    give_back_memory()
    mean = np.average(z, weights=n)
    return Model(net, languages, thresholds, float(max(np.sqrt(np.average((z - mean) ** 2, weights=n)), 1e-3) / 2))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """__id and __score of every row, and the columns named in ``carry``."""
    carry = carry or []
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    own = docs.select(docs[key].cast("long").alias("__id"), docs[text].alias("__text"), *[docs[c] for c in carry])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two tables and the trigram model

    def run(batches):
        model = shared.value
        for batch in batches:
            for p in text_pieces(batch.column(1), PIECE_BYTES // 2):
                n = p.hi - p.lo
                cols = [batch.column(0).slice(p.lo, n), pa.array(model.score(p).astype(float))]
                cols += [batch.column(2 + i).slice(p.lo, n) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "__score", *carry])

    return own.mapInArrow(released(run), "__id long, __score double" + kinds)
