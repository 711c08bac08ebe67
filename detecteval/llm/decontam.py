"""Benchmark decontamination (operator 12): prefix-filtered set join, exact windows.

A window is ``window`` consecutive words of a benchmark item (an item with fewer
words is one window); a document word inside any occurrence of a window is hit.
A window is looked for as the set of its ``shingle``-word shingles, all of which a
document must hold:

1. The documents count how often they hold each shingle of any window (texts are
   read once; a bit map of bounded size spares all other shingles).
2. Each window orders its shingles by that rarity. Containment of the whole set
   needs a prefix of one token: the rarest. Windows with a shingle that no
   document holds end here.
3. The documents give the places of prefix tokens, with the words around them
   that a window could cover (texts are read a second time, once more behind a
   bit map). They are joined to the windows by token; length and positional
   bounds drop windows that would begin before or end after the text; what is
   left is compared word for word.

Hot passages: a token's documents are never gathered. The join sides are
(token, place) and (token, window), which AQE splits or broadcasts by measured
size; a task's Python state is one piece of texts. A document's hits are merged
in a window over that document alone.

Defined cases: null or empty text has no words and no hits. Rows of the benchmark
with null id take no part; repeated item ids count once, their windows are those
of all their rows. Each document row gives one row; rows equal in id and text
get equal results, a null doc_id stays null. Extra columns are ignored. An empty
benchmark hits nothing.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .arrays import _ORDER, lower_ascii, map_batches, mix, split_words, text_pieces

WINDOW, SHINGLE = 10, 4
#: Words are made of digits, ASCII letters and everything beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[0x30:0x3A] = _BREAK[0x41:0x5B] = _BREAK[0x61:0x7B] = _BREAK[0x80:] = False
MOST_BITS = 1 << 27


def words_of(piece):
    """Lower-cased bytes of a piece and its words."""
    data = lower_ascii(piece.data)
    return data, split_words(data, piece.offsets, _BREAK[data])


def runs(words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (word number in the piece) and hash of every ``size``-word run inside one text."""
    count = np.diff(words.offsets)
    n = np.maximum(count - size + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(total) - (np.cumsum(n) - n)[text] + words.offsets[:-1][text]
    acc = np.full(total, size, np.uint64)
    for j in range(size):
        acc += words.hashes[at + j] * _ORDER[j]
    return at, mix(acc)


def _bits(hashes: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Bit map of hashed tokens: 1,024 bits for each, 2^16 to ``MOST_BITS`` (16 MB)
    in all. It only spares rows: with far more tokens than bits, all of them pass."""
    bits = min(MOST_BITS, 1 << max(16, (1024 * hashes.count()).bit_length()))
    words = (hashes.select(F.pmod(F.col(column), F.lit(bits)).alias("p"))
             .selectExpr("p div 64 as w", "shiftleft(1L, cast(p % 64 as int)) as b")
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    table = np.zeros(bits // 64, np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint64)
    return bits, table


def _in_bits(hashes: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    p = hashes & np.uint64(bits - 1)
    return (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def windows(items: DataFrame, text: str, key: str, window: int, shingle: int) -> DataFrame:
    """One row per window and shingle: item, w1, w2 (digest), words, off, token."""
    def run(batch):
        cols: list[list] = [[] for _ in range(6)]
        for p in text_pieces(batch.column(1)):
            data, words = words_of(p)
            raw = data.tobytes()
            for i in range(p.hi - p.lo):
                lo, hi = int(words.offsets[i]), int(words.offsets[i + 1])
                own = [raw[words.starts[k]:words.ends[k]].decode("utf-8", "replace") for k in range(lo, hi)]
                size = min(window, len(own))
                for at in range(len(own) - size + 1 if size else 0):
                    part = own[at:at + size]
                    digest = np.frombuffer(hashlib.blake2b(" ".join(part).encode(), digest_size=16).digest(), np.int64)
                    step = min(shingle, size)
                    h = words.hashes[lo + at:lo + at + size]
                    for off in range(size - step + 1):
                        token = np.array([step], np.uint64)
                        for j in range(step):
                            token += h[off + j:off + j + 1] * _ORDER[j]
                        for c, v in zip(cols, (batch.column(0)[p.lo + i].as_py(), int(digest[0]), int(digest[1]), part,
                                               off, int(mix(token).view(np.int64)[0]))):
                            c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                                                   pa.int32(), pa.int64()))],
            names=["item", "w1", "w2", "words", "off", "token"])
    rows = items.select(items[key].cast("string").alias("item"), items[text].alias("text")).where("item is not null")
    return map_batches(rows, run, "item string, w1 long, w2 long, words array<string>, off int, token long")


def _token_counts(docs: DataFrame, sizes: list[int], bits: int, table: np.ndarray) -> DataFrame:
    """How often the documents hold each token that may belong to a window."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch):
        for p in text_pieces(batch.column(0)):
            _, words = words_of(p)
            found = [h[_in_bits(h, bits, shared.value)] for h in (runs(words, s)[1] for s in sizes)]
            token, times = np.unique(np.concatenate(found), return_counts=True)
            if len(token):
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times)],
                                                 names=["token", "times"])
    return (map_batches(docs.select("text"), run, "token long, times long")
            .groupBy("token").agg(F.sum("times").alias("times")))


def _places(docs: DataFrame, sizes: list[int], window: int, bits: int, table: np.ndarray) -> DataFrame:
    """For each document one row (token null) with its words' number, and one row
    for each place of a prefix token, with the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch):
        for p in text_pieces(batch.column(1)):
            data, words = words_of(p)
            raw, ids = data.tobytes(), batch.column(0).slice(p.lo, p.hi - p.lo)
            n = np.diff(words.offsets)
            digest = np.array([np.frombuffer(hashlib.blake2b(
                repr(i).encode() + b"\0" + p.text_bytes(k).tobytes(), digest_size=16).digest(), np.int64)
                for k, i in enumerate(ids.to_pylist())])
            yield _batch(ids, digest[:, 0], digest[:, 1], n, None, None, None, None)
            for s in sizes:
                at, h = runs(words, s)
                keep = _in_bits(h, bits, shared.value)
                at, h = at[keep], h[keep]
                if not len(at):
                    continue
                text = np.searchsorted(words.offsets, at, side="right") - 1
                lo = np.maximum(at - window + s, words.offsets[text])
                hi = np.minimum(at + window, words.offsets[text + 1])
                around = [[raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[x:y], words.ends[x:y])]
                          for x, y in zip(lo, hi)]
                yield _batch(ids.take(pa.array(text)), digest[text, 0], digest[text, 1], n[text], h.view(np.int64),
                             at - words.offsets[text], at - lo, around)

    def _batch(ids, d1, d2, n, token, place, before, around):
        rows = len(ids)
        none = lambda v, t: pa.nulls(rows, t) if v is None else pa.array(v, t)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), none(token, pa.int64()),
             none(place, pa.int64()), none(before, pa.int32()), none(around, pa.list_(pa.string()))],
            names=["doc_id", "d1", "d2", "n_words", "token", "place", "before", "around"])
    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, d1 long, d2 long, n_words long, token long, place long, before int, "
                       "around array<string>")


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
                item_key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, holders): each document row (doc_id, d1, d2, n_words);
    each occurrence of a window (d1, d2, w1, w2, start, end, in words); and the
    items of each window (w1, w2, item)."""
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    shingled = checkpoint(windows(items, item_text, item_key, window, shingle))
    wanted = shingled.select("w1", "w2", "words", "off", "token").dropDuplicates(["w1", "w2", "off"])
    sizes = sorted({int(r.s) for r in shingled.select(F.least(F.size("words"), F.lit(shingle)).alias("s"))
                    .distinct().collect()})
    bits, table = _bits(shingled.select("token").distinct(), "token")
    rarity = _token_counts(docs, sizes, bits, table) if sizes else None
    if rarity is None:
        prefix = checkpoint(wanted.withColumn("length", F.size("words")))
    else:
        # the order of a window's shingles: rarest first; the prefix of a full containment is one token
        order = F.row_number().over(Window.partitionBy("w1", "w2").orderBy("times", "token", "off"))
        prefix = checkpoint(wanted.join(rarity, "token", "left")
                            .withColumn("times", F.coalesce("times", F.lit(0))).withColumn("place_in_order", order)
                            .where("place_in_order = 1 and times > 0")
                            .select("w1", "w2", "words", "off", "token", F.size("words").alias("length")))
    bits, table = _bits(prefix.select("token").distinct(), "token")
    placed = checkpoint(_places(docs, sizes, window, bits, table))
    spans = (placed.where("token is not null").join(prefix, "token")
             .withColumn("start", F.col("place") - F.col("off"))
             .where("start >= 0 and start + length <= n_words and before >= off")
             .where(F.slice("around", F.col("before") - F.col("off") + 1, F.col("length")) == F.col("words"))
             .select("d1", "d2", "w1", "w2", "start", (F.col("start") + F.col("length")).alias("end")).distinct())
    holders = shingled.select("w1", "w2", "item").distinct()
    return placed.where("token is null").select("doc_id", "d1", "d2", "n_words"), spans, holders


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
                  item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE
                  ) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, spans, holders = occurrences(docs, items, text, key, item_text, item_key, window, shingle)
    spans = checkpoint(spans)
    before = F.max("end").over(Window.partitionBy("d1", "d2").orderBy("start", "end")
                               .rowsBetween(Window.unboundedPreceding, -1))
    hit = (spans.select("d1", "d2", "start", "end").distinct().withColumn("done", before)
           .groupBy("d1", "d2")
           .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("done", F.lit(0)))))
                .alias("n_hit")))
    found = (spans.select("d1", "d2", "w1", "w2").distinct().join(holders, ["w1", "w2"])
             .select("d1", "d2", "item").distinct().groupBy("d1", "d2")
             .agg(F.count(F.lit(1)).alias("n_items"),
                  F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")))
    return (rows.join(hit.join(found, ["d1", "d2"]), ["d1", "d2"], "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item, ws, least({WINDOW}, len(ws)) AS size FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(ws[k:k + size - 1], ' ') AS w
        FROM (SELECT item, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM il)),
grams AS (SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS w
          FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k
                FROM d, (SELECT DISTINCT size FROM win) WHERE len(ws) >= size)),
hits AS (SELECT doc_id, item, k, g.size AS size FROM grams g JOIN win USING (size, w)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
