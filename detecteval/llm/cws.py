"""Document fingerprints (operator 2): consistent weighted sampling.

A text is a bag of weighted terms: its word pairs (its word, if it has one
only), weighted by how often they occur. For each of ``SAMPLES`` samples and
each term, three hash-seeded variables are drawn, r and c from Gamma(2, 1) and
b from U(0, 1). With t = floor(ln w / r + b), the term's value is
ln c - r (t - b) - r; the sample is the (term, t) of the smallest value. Two
bags agree in a sample with a probability equal to their generalised Jaccard
similarity, sum of the smaller weights / sum of the larger ones, so the share
of equal samples estimates it. A sample is kept as 16 bits of a hash; the
fingerprint is their hexadecimal string.

Defined cases: a text without words has the empty fingerprint "", whose
likeness to another empty one is 1 and to any other 0. Null text is empty.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Piece, lower_ascii, map_batches, mix, split_words, stream, text_pieces

SAMPLES = 64
_SALT, _ODD = stream(41, SAMPLES), stream(43, SAMPLES) | U64(1)
_TERM_BITS = 44


def _gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of ``size`` equal steps."""
    p = (np.arange(size) + 0.5) / size
    x = np.sqrt(2 * p) + p
    for _ in range(60):  # Newton on 1 - exp(-x) (1 + x) = p
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - p) / (x * np.exp(-x)), x / 4)
    return x


_tables: list[np.ndarray] = []


def _draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term and sample, [terms, SAMPLES]."""
    if not _tables:
        g = _gamma_table()
        _tables.extend((g.astype(np.float32), np.log(g).astype(np.float32)))
    g = (terms[:, None] ^ _SALT) * _ODD
    g ^= g >> U64(31)
    g *= U64(0xD6E8FEB86659FD93)
    parts = g.view(np.uint16).reshape(*g.shape, 4)  # the upper three are well mixed
    return (_tables[0][parts[..., 3]], _tables[1][parts[..., 2]], parts[..., 1].astype(np.float32) / np.float32(1 << 16))


def _minima(terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray, step: int = 2048) -> np.ndarray:
    """Smallest value of each sample over terms[bounds[i]:bounds[i+1]], none empty."""
    distinct, back = np.unique(terms, return_inverse=True)
    once = np.empty((len(distinct), SAMPLES), np.float32)  # values at weight 1, where t = 0
    for lo in range(0, len(distinct), step):
        r, ln_c, b = _draws(distinct[lo:lo + step])
        once[lo:lo + step] = ln_c - r + r * b
    out = np.empty((len(bounds) - 1, SAMPLES), np.float32)
    heavy = np.flatnonzero(weights > 1)
    lo = 0
    while lo < len(out):  # some texts at a time
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 8 * step, side="right")) - 1)
        hi = min(hi, len(out))
        values = once[back[bounds[lo]:bounds[hi]]]
        own = heavy[np.searchsorted(heavy, bounds[lo]):np.searchsorted(heavy, bounds[hi])]
        for k in range(0, len(own), step):
            at = own[k:k + step]
            r, _, b = _draws(terms[at])
            t = np.floor(np.log(weights[at]).astype(np.float32)[:, None] / r + b)
            values[at - bounds[lo]] -= r * t
        out[lo:hi] = np.minimum.reduceat(values, bounds[lo:hi] - bounds[lo], axis=0)
        lo = hi
    return out


def fingerprints(p: Piece) -> np.ndarray:
    """[texts, SAMPLES] 16-bit samples; all zero for a text without words."""
    words = split_words(lower_ascii(p.data), p.offsets)
    count = np.diff(words.offsets)
    h = words.hashes
    text = np.repeat(np.arange(len(count)), count)
    paired = np.zeros(len(h), bool)
    paired[:-1] = text[:-1] == text[1:]
    use = paired | (count[text] == 1)
    second = np.append(h[1:], U64(0))
    term = mix(h * U64(0x9E3779B97F4A7C15) + np.where(paired, second, U64(0)))[use] >> U64(64 - _TERM_BITS)
    key = np.sort((text[use].astype(U64) << U64(_TERM_BITS)) | term)
    out = np.zeros((len(count), SAMPLES), np.uint16)
    if not len(key):
        return out
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    weights = np.diff(np.append(new, len(key)))
    text = (key[new] >> U64(_TERM_BITS)).astype(np.int64)
    full = np.unique(text)
    bounds = np.append(np.searchsorted(text, full), len(text))
    low = _minima(mix(key[new] & U64((1 << _TERM_BITS) - 1)), weights, bounds)
    bits = mix(low.view(np.uint32).astype(U64))
    out[full] = (bits & U64(0xFFFF)).astype(np.uint16) | np.uint16(1)  # never the empty mark
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (x == y).mean(axis=1)


def to_text(samples: np.ndarray) -> list[str]:
    """Four hexadecimal digits a sample; "" for a text without words."""
    empty = ~samples.any(axis=1)
    raw = samples.astype(">u2")
    return ["" if e else row.tobytes().hex() for e, row in zip(empty, raw)]


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint."""
    def run(batch):
        for p in text_pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.lo, p.hi - p.lo), pa.array(to_text(fingerprints(p)))],
                                             names=["doc_id", "fingerprint"])
    return map_batches(docs.select(docs[key].cast("long").alias("doc_id"), docs[text]), run, "doc_id long, fingerprint string")


_LOWEST = -(1 << 63)


def in_order(docs: DataFrame, text: str, key: str, buckets: int) -> DataFrame:
    """Rows (bucket, guard, doc_id, text) sorted by doc_id within buckets of
    consecutive ids, each bucket followed by the first row of the next one as a
    guard (the last bucket by the very first row). Ids that are null come first.
    The driver holds one bound and one id for each bucket."""
    ids = docs.select(F.coalesce(docs[key].cast("long"), F.lit(_LOWEST)).alias("k"))
    edges = ids.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], max(10000, 20 * buckets))
                    .alias("e")).first()["e"] or []
    edges = np.unique(np.array(edges, np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="right").astype(np.int32))

    firsts = {r["b"]: r["k"] for r in ids.groupBy(bucket("k").alias("b")).agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    # the bucket that each first row guards
    guards = {firsts[b]: order[i - 1] for i, b in enumerate(order)}
    first_keys = np.array(sorted(guards), np.int64)
    guarded = np.array([guards[k] for k in first_keys.tolist()], np.int64)

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        """2 * bucket for the row itself, 2 * bucket + 1 where it is a guard."""
        own = 2 * np.searchsorted(edges, k.to_numpy(), side="right")
        at = np.minimum(np.searchsorted(first_keys, k.to_numpy()), max(len(first_keys) - 1, 0))
        is_first = first_keys[at] == k.to_numpy() if len(first_keys) else np.zeros(len(k), bool)
        return pd.Series([[a, 2 * int(guarded[g]) + 1] if f else [a] for a, g, f in zip(own.tolist(), at.tolist(), is_first.tolist())])

    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(_LOWEST)).alias("k"),
                       docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return (rows.select("k", "doc_id", "text", F.explode(places("k")).alias("place"))
            .select(F.shiftright("place", 1).alias("bucket"), (F.col("place") % 2).alias("guard"), "k", "doc_id", "text")
            .repartition("bucket").sortWithinPartitions("bucket", "guard", "k", "text"))


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as
    many of the following document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id",
                           buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of
    the next document by doc_id (after the last one: the first). Every text
    moves once, in a shuffle by ranges of doc_id; a task holds a few texts.
    Rows that share a doc_id follow each other in the order of their texts."""
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def flush(ids, texts, guards):
        """Rows but the last one, which waits for its follower (or is a guard)."""
        n = len(texts) - 1
        edited = [edited_text(texts[i], texts[i + 1]).encode() for i in range(n)]
        own = fingerprints_of([t.encode() for t in texts] + edited)
        own, changed = own[:n + 1], own[n + 1:]
        keep = np.flatnonzero(~np.array(guards[:n], bool))
        near_next = likeness(own[:n], own[1:])
        near_edited = likeness(own[:n], changed)
        names, edited_names = to_text(own[:n]), to_text(changed)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
             pa.array([hashlib.sha256(edited[i]).hexdigest() for i in keep], pa.string()),
             pa.array([names[i] for i in keep], pa.string()), pa.array([edited_names[i] for i in keep], pa.string()),
             pa.array(near_edited[keep]), pa.array(near_next[keep])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids, texts, guards, size = [], [], [], 0
        for batch in batches:
            for g, i, t in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                ids.append(i)
                texts.append(t)
                guards.append(g == 1)
                size += len(t)
                if size > 200_000 and len(texts) > 1:
                    yield flush(ids, texts, guards)
                    ids, texts, guards, size = ids[-1:], texts[-1:], guards[-1:], len(t)
        if len(texts) > 1:
            yield flush(ids, texts, guards)

    return in_order(docs, text, key, buckets).mapInArrow(run, _OUT)


def fingerprints_of(raw: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    return fingerprints(Piece(0, len(raw), data, offsets))
