"""Near-duplicate documents (operator 8): MinHash with a multi-index Hamming join.

A document's set holds its distinct word shingles; documents are linked when
intersection / union >= ``percent`` / 100, checked on the full sets. The search
for pairs is a *multi-index Hamming join*: the MinHash signature has 64 symbols
of 16 bits, cut into 16 chunks of 4. Two signatures that differ in at most 31
symbols agree, by the pigeonhole principle, in some chunk up to one symbol, so
the keys "chunk without one symbol" (64 for each document) find every pair
within that distance. Pairs found that are further apart are not thrown away: every
pair that shares a key is decided by its sets. A pair of similarity 0.75 agrees in
3 symbols of a chunk with probability 0.74, so it shares no key with probability
0.26 ** 16, about 5e-10.

Steps, each a Spark job that splits hot groups:

1. Documents with equal sets become one class, whose smallest doc_id stands
   for it (partial aggregation; copies never meet in one task).
2. The keys of all classes are range-partitioned by (key, size, id), so a hot
   key spreads over tasks. One pass links each row to the one before it and to
   the first of its size class: as many candidates as rows, not all pairs.
   Rows without a partner of fitting size go.
3. Each row's two candidates of nearest signature are confirmed on full sets, and
   connected components give each class a label.
4. All pairs of one key whose labels still differ are compared (hot keys in
   blocks of ``block_rows`` rows, block against block), each pair under the first
   key it shares only, by an exact bound: the shingles of a set are counted in 512
   cells, and the sum of the smaller counts is never below the size of the
   intersection. What is left is confirmed on full sets. So no link between
   components is lost, and neither a group that step 3 has joined nor one of
   unlinked look-alikes comes out as all its pairs.

The large intermediate tables are written as compressed columns and deleted as soon
as the next one stands.

Defined cases: a text without words has an empty set, size 0, and is linked
with nothing; null text counts as empty. Rows that share a doc_id count as one
document: all their sets are in one component. A null doc_id takes no part:
component_id null, kept true. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, discard, written
from .arrays import (PIECE_BYTES, distinct_per_text, lower_ascii, map_batches, released, shingles, split_words,
                     stream, text_pieces)

SYMBOLS, CHUNK, ERRORS = 64, 4, 1
CELLS, FULL_CELL = 512, 255
MAX_DISTANCE = (SYMBOLS // CHUNK) * (ERRORS + 1) - 1
_XOR = stream(31, SYMBOLS)
_MUL = stream(37, SYMBOLS) | np.uint64(1)


def text_sets(piece, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return distinct_per_text(*shingles(split_words(lower_ascii(piece.data), piece.offsets), size))


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit symbols [texts, 64]; all sets must have members."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        low = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
        out[:, k] = (low >> np.uint64(16)).astype(np.uint16)
    return out


def signatures(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2) and signature of each document."""
    def run(batch):
        for p in text_pieces(batch.column(1), PIECE_BYTES // 2):
            sets = text_sets(p, size)
            n = np.array([len(s) for s in sets], np.int64)
            digest = np.array([_digest(s) for s in sets])
            full = np.flatnonzero(n)
            sig = [None] * len(sets)
            if len(full):
                for i, row in zip(full.tolist(), minhash([sets[i] for i in full])):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p.lo, p.hi - p.lo), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"])
    return map_batches(docs.select(docs[key].cast("long").alias("doc_id"), docs[text]), run,
                       "doc_id long, n_shingles long, d1 long, d2 long, sig binary", release=True)


def cell_counts(texts: DataFrame, size: int) -> DataFrame:
    """id, set digest and cell counts of each text's set."""
    def run(batch):
        for p in text_pieces(batch.column(1), PIECE_BYTES // 2):
            sets = text_sets(p, size)
            cells = [np.minimum(np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS),
                                FULL_CELL).astype(np.uint8).tobytes() for s in sets]
            digest = np.array([_digest(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.lo, p.hi - p.lo), pa.array(digest[:, 0]),
                                              pa.array(digest[:, 1]), pa.array(cells, pa.binary())],
                                             names=["id", "d1", "d2", "cells"])
    return map_batches(texts.select("id", "text"), run, "id long, d1 long, d2 long, cells binary", release=True)


def _digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def _first_shared_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the first chunk key that two signatures share (rows that share one)."""
    same = (x == y).reshape(-1, SYMBOLS // CHUNK, CHUNK)
    agree = same.sum(axis=2)
    chunk = (agree >= CHUNK - ERRORS).argmax(axis=1)
    row = np.arange(len(x))
    skip = np.where(agree[row, chunk] == CHUNK, 0, same[row, chunk].argmin(axis=1))
    return chunk * CHUNK + skip


def _may_link(cx: np.ndarray, cy: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """False only where the cell counts prove that the sets are too unlike."""
    low = np.minimum(cx, cy)
    both = low.sum(axis=1, dtype=np.int64)
    return (100 * both >= percent * (nx + ny - both)) | (low == FULL_CELL).any(axis=1)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """[rows, 64] keys: each chunk of 4 symbols without each one of them."""
    out = []
    for c in range(SYMBOLS // CHUNK):
        part = sig[:, c * CHUNK:(c + 1) * CHUNK].astype(np.int64)
        for skip in range(CHUNK):
            key = np.full(len(sig), c * CHUNK + skip, np.int64)
            for j in range(CHUNK):
                if j != skip:
                    key = (key << 16) | part[:, j]
            out.append(key)
    return np.stack(out, axis=1)


def _key_rows(classes: DataFrame) -> DataFrame:
    def run(batch):
        for lo in range(0, batch.num_rows, 2000):
            b = batch.slice(lo, 2000)
            keys = chunk_keys(_symbols(b.column(2)))
            ids, n = (np.repeat(b.column(c).to_numpy(), SYMBOLS) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(n), pa.array(ids)],
                                             names=["key", "n", "id"])
    return map_batches(classes.select("id", "n", "sig"), run, "key long, n long, id long", release=True)


def _size_class(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64)


_RUNS = "key long, n long, id long, first long, prev long, edge boolean"


def _key_runs(rows: DataFrame, percent: int) -> DataFrame:
    """Rows that have a neighbour of fitting size under their key, with the id
    before them and the first id of their size class. Rows are range-partitioned
    by (key, n, id); the first and last row of each partition come out marked,
    since their neighbour may be in the next one."""
    def run(batches):
        carry = None
        begun = False
        for b in batches:
            key, n, i = (b.column(c).to_numpy() for c in range(3))
            if not len(key):
                continue
            if carry is not None:
                key, n, i = np.append(carry[0], key), np.append(carry[1], n), np.append(carry[2], i)
            cls = _size_class(n, percent)
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            first = i[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if carry is not None:  # the first row is the last one of the batch before
                first = np.where(np.cumsum(new) == 1, carry[3], first)
            prev = np.where(same, np.append(i[:1], i[:-1]), -1)
            linked = same.copy()
            linked[:-1] |= same[1:]
            if carry is not None:
                linked[0] |= carry[5]
                prev[0] = carry[4]
                same[0] = carry[5]
            edge = np.zeros(len(key), bool)
            edge[0] = not begun
            edge[0] |= carry is not None and carry[6]
            begun = True
            carry = (key[-1], n[-1], i[-1], first[-1], prev[-1], same[-1], bool(edge[-1]))
            keep = np.flatnonzero((linked | edge)[:-1])
            if len(keep):
                yield _run_batch(key[keep], n[keep], i[keep], first[keep], prev[keep], same[keep], edge[keep])
        if carry is not None:
            one = [np.array([x]) for x in carry[:6]]
            yield _run_batch(*one, np.array([True]))

    def _run_batch(key, n, i, first, prev, same, edge):
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(n), pa.array(i), pa.array(first, mask=first == i),
             pa.array(prev, mask=~same), pa.array(edge)], names=["key", "n", "id", "first", "prev", "edge"])

    return (rows.repartitionByRange("key", "n", "id").sortWithinPartitions("key", "n", "id")
            .mapInArrow(released(run), _RUNS))


def _nearest(pairs: DataFrame, classes: DataFrame, most: int = 2) -> DataFrame:
    """For each b the ``most`` pairs (a, b) of nearest signatures, ties to smaller a.
    The others are not lost: step 4 looks at every pair that is not yet connected."""
    left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))

    def run(batch):
        far = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.astype(np.int32))],
                                         names=["a", "b", "far"])
    measured = map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b"), run,
                           "a long, b long, far int", release=True).groupBy("a", "b").agg(F.min("far").alias("far"))
    order = F.row_number().over(Window.partitionBy("b").orderBy("far", "a"))
    return measured.withColumn("place", order).where(F.col("place") <= most).select("a", "b")


def _likely(docs: DataFrame, wanted: DataFrame, most_bits: int = 1 << 24) -> DataFrame:
    """``docs`` without most rows whose id is not wanted, so that few texts
    travel to the join that follows and decides. A bit map of hashed ids in rows of
    64 bits, of ``most_bits`` bits (262,144 rows) at most, whatever the number of ids; with far
    more ids than bits it lets all rows pass."""
    bits = min(most_bits, 1 << max(16, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = (wanted.select(place.alias("p")).selectExpr("p div 64 as __w", "shiftleft(1L, cast(p % 64 as int)) as b")
             .groupBy("__w").agg(F.bit_or("b").alias("__b")))
    return (docs.withColumn("__p", place).withColumn("__w", F.expr("__p div 64"))
            .join(F.broadcast(words), "__w")  # bits / 64 rows at most
            .where("(__b & shiftleft(1L, cast(__p % 64 as int))) <> 0").select(*docs.columns))


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, group_rows: int = 256) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, checkpointed.

    A pair travels as one row with the text of b next to the text of a; the
    pairs of one a are dealt into groups of about ``group_rows``, and each task
    streams its groups with one set of a in memory."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    dealt = pairs.join(sizes, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / group_rows)).alias("part"))
    wanted = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = written(_likely(docs, wanted).join(wanted, "id"))
    rows = (dealt.join(texts.withColumnRenamed("id", "b"), "b")
            .select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id"), "text")
            .unionByName(dealt.select("a", "part").distinct()
                         .join(texts.withColumnRenamed("id", "a"), "a")
                         .select("a", "part", F.lit(0).alias("role"), F.col("a").alias("id"), "text")))

    def run(batches):
        at, anchors = None, []
        for batch in batches:
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            role, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found_a, found_b = [], []
            for p in text_pieces(batch.column(4), PIECE_BYTES // 2):
                for r, own in zip(range(p.lo, p.hi), text_sets(p, size)):
                    if group[r] != at:
                        at, anchors = group[r], []
                    if role[r] == 0:
                        anchors.append(own)
                    elif any(linked(x, own, percent) for x in anchors):
                        found_a.append(group[r][0])
                        found_b.append(ids[r])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())],
                                             names=["a", "b"])

    found = checkpoint(rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")
                       .mapInArrow(released(run), "a long, b long").distinct())
    discard(texts)
    return found


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of two sorted sets, by exact integers."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y) or not len(x):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each linked id.

    Alternating large-star and small-star over edges from a node ``u`` to a smaller ``v``:
    every step is a minimum per node (partially aggregated) and a join, so no node's
    neighbours are collected. An edge remembers whether its round moved it; rounds end
    when none has moved."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where("u <> v").distinct())
    moved = not edges.isEmpty()
    while moved:
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))  # larger neighbours are never the least
        large = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.isnotnull("m").alias("moved"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"),
                                            F.expr("moved or v <> m").alias("moved"))
        rows = checkpoint(small.where("u <> v").groupBy("u", "v").agg(F.max("moved").alias("moved")))
        edges, moved = rows.select("u", "v"), not rows.where("moved").isEmpty()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _pairs_across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key with different components and fitting sizes, unless the cell
    counts rule them out. ``rows``: key, i, j (blocks that meet), s (own block), n,
    id, component, sig, cells."""
    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in range(7)] + [_symbols(batch.column(7))]
            new.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, CELLS))
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                new = [np.concatenate((x, y)) for x, y in zip(held, new)]
            key, i, j, s, n, ident, comp, sig, cells = new
            found = []
            step = 1
            cand = np.arange(max(fresh, 1), len(key))
            while len(cand):
                other = cand - step
                cand, other = cand[other >= 0], other[other >= 0]
                near = ((key[cand] == key[other]) & (i[cand] == i[other]) & (j[cand] == j[other])
                        & (100 * n[other] >= percent * n[cand]))
                cand, other = cand[near], other[near]
                test = (comp[cand] != comp[other]) & ((i[cand] == j[cand]) | (s[cand] != s[other]))
                x, y = cand[test], other[test]
                for lo in range(0, len(x), 20_000):
                    u, w = x[lo:lo + 20_000], y[lo:lo + 20_000]
                    ok = _first_shared_key(sig[u], sig[w]) == key[u] >> 48
                    u, w = u[ok], w[ok]
                    ok = _may_link(cells[u], cells[w], n[u], n[w], percent)
                    u, w = u[ok], w[ok]
                    found.append(np.stack((np.minimum(ident[u], ident[w]), np.maximum(ident[u], ident[w]))))
                step += 1
            open_ = ((key == key[-1]) & (i == i[-1]) & (j == j[-1])
                     & (100 * n >= percent * n[-1]))
            held = [x[open_] for x in new]
            if found:
                pair = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    order = ["key", "i", "j", "n", "id"]
    return (rows.select("key", "i", "j", "s", "n", "id", "component", "sig", "cells")
            .repartition("key", "i", "j").sortWithinPartitions(*order)
            .mapInArrow(released(run), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5,
                    percent: int = 75, block_rows: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links), kept (doc_id = component_id)."""
    docs = docs.select(docs[key].alias(key), docs[text].alias(text))
    signed = written(signatures(docs, text, key, size))
    classes = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2")
                      .agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig")))
    sources = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    runs = written(_key_runs(_key_rows(classes), percent))
    over = runs.where("edge").selectExpr("id as b", "lag(id) over (partition by key order by n, id) as a")
    near = (runs.selectExpr("id as b", "explode(array(first, prev)) as a").unionByName(over)
            .where("a is not null and a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = checkpoint(_nearest(near, classes))
    links = confirm(first, sources, size, percent)
    labels = components(links)

    labelled = (runs.select("key", "n", "id").join(labels, "id", "left")
                .withColumn("component", F.coalesce("component", "id")))
    mixed = (labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.count(F.lit(1)).alias("members"))
             .where("lo < hi").select("key", F.ceil(F.col("members") / block_rows).alias("blocks")))
    open_rows = written(labelled.join(mixed, "key"))
    wanted = checkpoint(open_rows.select("id").distinct())
    cells = written(cell_counts(_likely(sources, wanted).join(wanted, "id"), size).dropDuplicates(["id", "d1", "d2"]))
    facts = classes.join(cells, ["id", "d1", "d2"]).select("id", "n", "sig", "cells")
    blocks = (open_rows.join(facts, ["id", "n"])
              .withColumn("s", F.pmod(F.xxhash64("id"), "blocks"))
              .withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .withColumn("i", F.least("s", "t")).withColumn("j", F.greatest("s", "t")))
    second = checkpoint(_pairs_across(blocks, percent).join(first, ["a", "b"], "left_anti"))
    discard(runs, open_rows, cells)
    more = confirm(second, sources, size, percent)
    # rows that share a doc_id but differ in text are one document: its sets are linked
    member = signed.join(classes.select("d1", "d2", "id"), ["d1", "d2"], "left")
    several = (signed.where("doc_id is not null").groupBy("doc_id")
               .agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi"))
               .where("lo <> hi").select("doc_id"))
    shared = checkpoint(member.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct())
    # on from the stars of step 3, not from its links again
    final = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
                       .unionByName(shared.where("b is not null")))
    joined = (shared.select(F.col("a").alias("doc_id")).distinct()
              .join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
              .select("doc_id", F.coalesce("component", "doc_id").alias("own")))
    out = (member.join(final, "id", "left").join(joined, "doc_id", "left")
           .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(),
                                                  F.coalesce("own", "component", "id", "doc_id")).alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
