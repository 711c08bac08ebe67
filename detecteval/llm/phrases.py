"""Phrase collocation mining (operator 11): multikey quicksort of suffix pointers.

Texts are cut at punctuation and line ends into pieces, pieces into words. The
suffix of a word is that word and the next ones of its piece, ``most`` words at
most; a phrase occurs once for every suffix that it begins.

1. Each task reads texts and hands over its distinct suffixes with their numbers
   (a combiner, so a hot phrase is one row a batch). They are *routed by their
   leading words*: the ranges between suffixes taken from a sample of texts, one
   range for each shuffle partition. The sample only balances the ranges. A hot
   leading word spreads over as many ranges as its suffixes need, and equal
   suffixes meet.
2. A task takes its range in order, in chunks of bounded size. In each a *multikey
   three-way quicksort* works on pointers to the suffixes: all open partitions are
   split at once by a pivot word of the current depth into less, equal and greater;
   an equal partition is a phrase, the sum of its numbers its count, and goes on at
   the next depth, down to ``most`` words. A partition whose numbers sum to less
   than ``least`` is abandoned - but not one whose words also lead the first or last
   suffix of the chunk, because the rest of it may lie in the next one; those counts
   are added up afterwards.
3. Cuts, scores and the test for longer phrases are joins of the frequent phrases.

Defined cases: null text counts as empty; a null lang is ``und`` (and one with a
lang of that name). Repeated rows count as often as they occur; ids are not read.
Texts without words add nothing; an empty table gives no rows. Words may hold any
other character, control characters included. Extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .arrays import lower_ascii, map_batches, ragged, text_pieces

MOST, LEAST, TOP, HELD_BY = 3, 10, 2000, 50
PIECE_BYTES = 2 << 20
CHUNK_ROWS = 1 << 18
SAMPLE_CHARS, SAMPLED_A_RANGE = 16 << 20, 32

_ENDING = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True


# -- suffixes of a piece of texts -----------------------------------------------

def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; texts end words."""
    word = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, lengths)])])


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value, from 1, in the byte order that they have with a space
    after them (so rows of numbers sort as the joined suffixes), and the distinct values."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(pc.binary_join_element_wise(coded.dictionary, *_ENDING)).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _distinct(columns: list[np.ndarray], high: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and how often each occurs. Values are below ``high``."""
    width = max(1, int(high).bit_length())
    packed, bits = columns[0].astype(np.int64), width
    for c in columns[1:]:
        if bits + width > 63:  # number the rows so far anew
            packed = np.unique(packed, return_inverse=True)[1]
            bits = len(packed).bit_length()
        packed = (packed << width) | c
        bits += width
    order = np.argsort(packed, kind="stable") if width * len(columns) > 63 else None
    if order is None:
        packed.sort()
    else:
        packed = packed[order]
    new = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    times = np.diff(np.append(new, len(packed)))
    if order is not None:
        return [c[order[new]] for c in columns], times
    packed, mask = packed[new], (1 << width) - 1
    return [(packed >> (width * (len(columns) - 1 - k))) & mask for k in range(len(columns))], times


def suffixes(docs: DataFrame, text: str, lang: str, most: int, borders: list[str] = ()) -> DataFrame:
    """range, lang, suffix (words, each followed by a space), times. The range of a
    suffix is the number of ``borders`` (suffixes in byte order) that are not after it."""
    ends = [b.split(" ")[:-1] for b in borders]
    flat = pa.array([w for words in ends for w in words], pa.large_string())
    at = np.cumsum([0] + [len(w) for w in ends])
    own_shape = [np.array([at[i] + k if k < len(w) else -1 for i, w in enumerate(ends)], np.int64) for k in range(most)]

    def run(batch):
        for p in text_pieces(batch.column(1), PIECE_BYTES):
            data = lower_ascii(p.data)
            starts, stops = _spans(data, p.offsets)
            n = len(starts)
            if not n:
                continue
            ids, names = _ranked(pa.concat_arrays([_strings(data, starts, stops), flat]))
            ids, lead = ids[:n], ids[n:]
            # the number of a word's stretch: texts and cuts both end one
            inside = np.diff(np.searchsorted(starts, p.offsets))
            cuts = np.cumsum(_CUT[data])[starts] + np.repeat(np.arange(p.hi - p.lo), inside)
            langs = batch.column(0).slice(p.lo, p.hi - p.lo).dictionary_encode()
            own = np.repeat(langs.indices.to_numpy(), inside)
            columns = [ids]
            for k in range(1, most):
                nxt = np.zeros(n, np.int64)
                if k < n:
                    nxt[:n - k] = np.where(cuts[k:] == cuts[:n - k], ids[k:], 0)
                columns.append(nxt)
            if len(lead):  # borders sort before the suffixes that equal them: their lang is 0
                columns = [np.append(c, np.where(shape < 0, 0, lead[shape])) for c, shape in zip(columns, own_shape)]
            (*ids, own), times = _distinct([*columns, np.append(own + 1, np.zeros(len(borders), np.int64))],
                                           max(len(names), len(langs.dictionary)) + 1)
            border = own == 0
            where = np.cumsum(np.where(border, times, 0))[~border]
            ids, own, times = [c[~border] for c in ids], own[~border], times[~border]
            for lo in range(0, len(own), 100_000):
                part = [pa.array(c[lo:lo + 100_000] - 1) for c in ids]
                spelled = [names.take(pc.if_else(pc.less(c, 0), None, c)) for c in part]
                joined = pc.binary_join_element_wise(*spelled, *_ENDING, null_handling="skip")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[lo:lo + 100_000].astype(np.int32)),
                     langs.dictionary.take(pa.array(own[lo:lo + 100_000] - 1)), joined.cast(pa.string()),
                     pa.array(times[lo:lo + 100_000])], names=["range", "lang", "suffix", "times"])
    return map_batches(docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text]), run,
                       "range int, lang string, suffix string, times long")


def range_borders(docs: DataFrame, text: str, lang: str, most: int, ranges: int) -> list[str]:
    """At most ``ranges`` - 1 suffixes, in the order of their words, that cut the
    suffixes of a sample of texts (about ``SAMPLE_CHARS`` code points, drawn by hash)
    evenly; about ``SAMPLED_A_RANGE`` suffixes for each range reach the driver."""
    chars = docs.agg(F.sum(F.length(docs[text]))).first()[0] or 0
    drawn = docs.where(F.pmod(F.xxhash64(docs[text]), F.lit(max(1, chars // SAMPLE_CHARS))) == 0)
    rows = min(chars, SAMPLE_CHARS) // 6
    some = F.pmod(F.xxhash64("suffix", F.lit(1)), F.lit(max(1, rows // (SAMPLED_A_RANGE * ranges)))) == 0
    found = suffixes(drawn, text, lang, most).where(some).select("suffix").toArrow()["suffix"].to_pylist()
    found.sort(key=str.encode)
    picked = [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []
    return sorted(set(picked), key=str.encode)


# -- multikey quicksort ------------------------------------------------------------

def _split(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """One three-way split of every partition ``rows[start:end]`` by the median of
    its first, middle and last key. Returns the pointers in their new order and the
    borders [partitions, 4] of less, equal and greater."""
    sizes = ends - starts
    k = keys[rows]
    first, mid, last = k[starts], k[(starts + ends) >> 1], k[ends - 1]
    pivot = np.maximum(np.minimum(first, mid), np.minimum(np.maximum(first, mid), last))
    part = np.repeat(np.arange(len(starts)), sizes)
    at = pivot[part]
    cls = (k > at).astype(np.int8) - (k < at) + 1
    counts = np.stack([np.add.reduceat((cls == c).astype(np.int64), starts) for c in range(3)], axis=1)
    borders = np.concatenate((starts[:, None], starts[:, None] + np.cumsum(counts, axis=1)), axis=1)
    out = np.empty_like(rows)
    for c in range(3):
        hit = cls == c
        before = np.cumsum(hit) - hit
        own = part[hit]
        out[borders[own, c] + before[hit] - before[starts][own]] = rows[hit]
    return out, borders


def multikey_quicksort(columns: list[np.ndarray], weights: np.ndarray, least: int, keep: list[list[int]] = ()
                       ) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the leading words of weighted suffixes.

    ``columns[0]`` is the lang of each suffix, ``columns[d]`` its word d, -1 past its
    end. For each depth: a member of every partition found there (a lang; a phrase of
    d words), and its weight. Partitions lighter than ``least`` are abandoned, but no
    lang, and none whose words lead one of ``keep``."""
    depths = len(columns)
    held = np.zeros(len(weights), np.int64)  # how many words a suffix shares with one of ``keep``
    for lead in keep:
        same = np.ones(len(weights), bool)
        for d in range(1, depths):
            same &= (columns[d] == lead[d - 1]) & (columns[d] >= 0)
            held = np.maximum(held, np.where(same, d, 0))
    rows = np.arange(len(weights))
    found = []
    starts, ends = (np.array([0]), np.array([len(rows)])) if len(rows) else (np.zeros(0, np.int64),) * 2
    for d in range(depths):
        keys = columns[d]
        done_rows, done_sizes, members, totals = [], [], [], []
        while len(starts):
            # the open partitions, packed one after the other
            sizes = ends - starts
            rows = rows[ragged(starts, sizes)]
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rows, borders = _split(keys, starts, ends, rows)
            total = np.concatenate(([0], np.cumsum(weights[rows])))
            marked = np.concatenate(([0], np.cumsum(held[rows] >= d)))
            lo, hi = borders[:, :-1].ravel(), borders[:, 1:].ravel()
            kind = np.tile([0, 1, 2], len(borders))
            live = (hi > lo) & ((total[hi] - total[lo] >= least) | (marked[hi] > marked[lo]))
            equal = live & (kind == 1)
            lo_e, hi_e = lo[equal], hi[equal]
            real = keys[rows[lo_e]] >= 0
            lo_e, hi_e = lo_e[real], hi_e[real]
            members.append(rows[lo_e])
            totals.append(total[hi_e] - total[lo_e])
            done_rows.append(rows[ragged(lo_e, hi_e - lo_e)])
            done_sizes.append(hi_e - lo_e)
            side = live & (kind != 1)
            starts, ends = lo[side], hi[side]
        rows = np.concatenate(done_rows) if done_rows else np.zeros(0, np.int64)
        sizes = np.concatenate(done_sizes) if done_sizes else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found.append((np.concatenate(members) if members else np.zeros(0, np.int64),
                      np.concatenate(totals) if totals else np.zeros(0, np.int64)))
    return found


def _phrases_of(lang: pa.Array, suffix: pa.Array, weights: np.ndarray, most: int, least: int):
    """The phrases of one chunk of sorted suffixes, with what of them lies in it."""
    lang = lang.dictionary_encode()
    own, names = lang.indices.to_numpy().astype(np.int64), lang.dictionary
    lists = pc.split_pattern(suffix, " ")
    length = np.diff(lists.offsets.to_numpy()) - 1  # the last one is empty
    coded = lists.flatten().dictionary_encode()
    flat, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    begin = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
    columns = [own] + [np.where(length > d, flat[np.minimum(begin + d, len(flat) - 1)], -1) for d in range(most)]
    edges = [[int(c[i]) for c in columns[1:]] for i in (0, len(own) - 1)]
    for d, (member, total) in enumerate(multikey_quicksort(columns, weights, least, edges)):
        for lo in range(0, len(member), 100_000):
            m = member[lo:lo + 100_000]
            parts = [words.take(pa.array(columns[1 + j][m])) for j in range(d)]
            phrase = pc.binary_join_element_wise(*parts, " ") if d else pa.array([""] * len(m))
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(own[m])), pa.array(np.full(len(m), d, np.int32)), phrase,
                 pa.array(total[lo:lo + 100_000])], names=["lang", "size", "phrase", "times"])


def _count_chunks(most: int, least: int, chunk_rows: int):
    """Over the sorted suffixes of a range, chunk by chunk."""
    def whole(held):
        table = pa.Table.from_batches(held).combine_chunks()
        lang, suffix, times = (table.column(c).combine_chunks() for c in ("lang", "suffix", "times"))
        yield from _phrases_of(lang, suffix, times.to_numpy(), most, least)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.select(["lang", "suffix", "times"]))
                rows += b.num_rows
            if rows >= chunk_rows:
                yield from whole(held)
                held, rows = [], 0
        if held:
            yield from whole(held)
    return run


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """lang, size, phrase, times: all phrases of 1 to ``most`` words that occur
    ``least`` times; size 0 (phrase "") has the number of words of each lang."""
    docs = docs.select(docs[text].alias("text"), docs[lang].alias("lang"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = range_borders(docs, "text", "lang", most, ranges)
    routed = (suffixes(docs, "text", "lang", most, borders).repartitionById(ranges, "range")
              .sortWithinPartitions("suffix", "lang"))
    parts = routed.mapInArrow(_count_chunks(most, least, chunk_rows), "lang string, size int, phrase string, times long")
    return (parts.groupBy("lang", "size", "phrase").agg(F.sum("times").alias("times"))
            .where((F.col("size") == 0) | (F.col("times") >= least)))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST,
                 top: int = TOP, held_by: int = HELD_BY, salts: int = 32) -> DataFrame:
    """The ``top`` phrases of 2 to ``most`` words of each lang: lang, rank, phrase, a, l, r, n, score.

    A phrase is left out if one longer candidate that holds it has at least
    ``held_by`` percent of its count."""
    counted = checkpoint(frequent(docs, text, lang, most, least))
    phrases = counted.where("size > 0").select("lang", "size", "phrase", "times")
    found = phrases.where("size > 1").withColumn("words", F.split("phrase", " ", -1))
    joined = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    cuts = (found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", F.col("times").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("first"),
                    joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("times").alias(count))
    big = lambda c: f"cast({c} as decimal(18,0))"
    scored = (cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
              .withColumn("score", F.expr(f"cast(1000000 * ({big('a')} * {big('a')}) div ({big('l')} * {big('r')}) as long)"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    holders = (found.where("size > 2")
               .withColumn("n_sub", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
               .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n_sub") + 1)))
               .select("lang", joined(F.col("at"), F.col("n_sub")).alias("phrase"), F.col("times").alias("longer"))
               .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    left = (scored.join(holders, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longer") < held_by * F.col("a"), F.lit(True)))
            .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = (left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
              .where(F.col("rank") <= top).drop("rank", "salt"))
    best = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .where(F.col("rank") <= top))
    words = counted.where("size = 0").select("lang", F.col("times").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                           "score")


SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
occ AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i
              FROM w, (SELECT unnest(range(1, {MOST} + 1)) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS ws
      FROM occ GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
cut AS (SELECT c.lang, c.phrase, c.m, c.f AS a, k, x.f AS l, y.f AS r,
               (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(f) AS longer
        FROM (SELECT *, unnest(range(1, m - s + 2)) AS i
              FROM (SELECT *, unnest(range(2, m)) AS s FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, phrase) WHERE sub.longer IS NULL OR 100 * sub.longer < {HELD_BY} * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
