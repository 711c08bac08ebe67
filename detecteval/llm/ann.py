"""Approximate nearest neighbours by inner product (operator 1): learned partitions.

Fitting, on a bounded sample (``sample_rows``): the graph of the sample's
nearest neighbours is cut into balanced parts by recursive bisection (power
iteration towards the second eigenvector of the graph, a split at the median,
then balanced swaps that reduce the cut). A small two-layer classifier, trained
in numpy, learns which parts hold a vector's neighbours.

Indexing: the classifier gives every row its part. Searching: it routes each
query to its likeliest parts, and all their rows are ranked exactly, in double
precision. How many parts is measured: ``check_queries`` queries are compared
with every row, and the fewest parts are taken that hold ``recall`` of their
true neighbours (a query gets further ones until they hold enough rows). On
vectors without any structure that can be most parts. Parts are dealt
into blocks of ``block_rows`` rows, and their queries into blocks too, so no
task holds a whole part. Equal vectors are indexed once, with their smallest
ids, so a vector that makes up a third of all rows costs one row.

The largest inner product is turned into a nearest-neighbour problem by one
more component, sqrt(max norm^2 - norm^2) for rows and 0 for queries.

Defined cases: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do those of another length than the most frequent
one (ties: the shorter). Ties in score go to the smaller id. Repeated rows of
an id count once for each different vector.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v as array<double>) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0)
                      & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0))
    size = (rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"))
            .orderBy(F.desc("c"), "n").limit(1).collect())
    return rows.where(F.size("v") == (size[0]["n"] if size else 0))


def graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The ``k`` largest inner products of each row with the others, [rows, k]."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for lo in range(0, n, block):
        s = x[lo:lo + block] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo:lo + block] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(near: np.ndarray, levels: int, seed: int = 1, rounds: int = 30, swaps: int = 10) -> np.ndarray:
    """Part of each node: ``levels`` bisections of the neighbour graph into
    halves that differ by one node at most."""
    n, k = near.shape
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), k), near.reshape(-1)
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    for _ in range(levels):
        inside = part[a] == part[b]
        u, w = a[inside], b[inside]
        degree = np.maximum(np.bincount(u, minlength=n), 1)
        size = np.maximum(np.bincount(part), 1)

        def centre(x):
            return x - (np.bincount(part, weights=x, minlength=len(size)) / size)[part]

        x = centre(rng.normal(size=n))
        for _ in range(rounds):
            x = centre(0.5 * x + 0.5 * np.bincount(u, weights=x[w], minlength=n) / degree)
            norm = np.sqrt(np.bincount(part, weights=x * x, minlength=len(size)))
            x /= np.maximum(norm, 1e-12)[part]
        order = np.lexsort((x, part))
        start = np.cumsum(size) - size
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - start[part[order]]
        side = (rank >= size[part] // 2).astype(np.int64)
        for _ in range(swaps):
            # gain of moving: neighbours on the other side minus those on this one
            gain = np.bincount(u, weights=np.where(side[u] != side[w], 1.0, -1.0), minlength=n)
            order = np.lexsort((-gain, side, part))
            group = part[order] * 2 + side[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            place = np.empty(n, np.int64)
            place[order] = rank
            # the i-th best of one side swaps with the i-th best of the other where both gain
            top = np.full((int(part.max()) + 1, 2, int(rank.max()) + 1), -np.inf)
            top[part, side, place] = gain
            good = top.min(axis=1) > 0
            good &= np.arange(good.shape[1]) < np.maximum(good.sum(axis=1, keepdims=True) // 2, 1)
            move = good[part, place]
            if not move.any():
                break
            side = np.where(move, 1 - side, side)
        part = part * 2 + side
    return part


class Router(NamedTuple):
    """Two-layer classifier of parts."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    norm2: float  # the largest squared norm of a row

    def inputs(self, v: np.ndarray, is_query: bool) -> np.ndarray:
        """Unit vectors with the extra component; queries have none of it."""
        own = (v * v).sum(axis=1)
        extra = np.zeros(len(v)) if is_query else np.sqrt(np.maximum(self.norm2 - own, 0))
        x = np.concatenate((v, extra[:, None]), axis=1)
        return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(router_inputs, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30,
                 batch: int = 256, rate: float = 3e-3, seed: int = 2) -> tuple:
    """Softmax regression on soft targets through one hidden layer, by Adam."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]) * 2, (x.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32),
         rng.normal(0, 1 / np.sqrt(hidden), (hidden, target.shape[1])).astype(np.float32), np.zeros(target.shape[1], np.float32)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            r = order[lo:lo + batch]
            h = np.maximum(x[r] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[r]) / len(r)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[r].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(p)


def fit_router(sample: np.ndarray, norm2: float, parts: int, neighbours: int = 16) -> Router:
    """Parts of the sample's neighbour graph, and the classifier of them.

    Each sampled vector is seen twice: as a row (target: its own part and those
    of its neighbours) and as a query (target: the parts of its neighbours)."""
    blank = Router(*[np.zeros(0)] * 4, norm2)
    rows, queries = blank.inputs(sample, False), blank.inputs(sample, True)
    near = graph(rows, neighbours)
    part = balanced_parts(near, int(np.log2(parts))) if parts > 1 else np.zeros(len(sample), np.int64)

    def shares(neighbour_rows, own):
        t = np.zeros((len(sample), parts), np.float32)
        np.add.at(t, (np.repeat(np.arange(len(sample)), neighbour_rows.shape[1]), part[neighbour_rows].reshape(-1)), 1.0)
        t[np.arange(len(sample)), part] += own
        return t / np.maximum(t.sum(axis=1, keepdims=True), 1e-9)

    same = np.allclose(rows[:, -1], 0, atol=1e-3)
    scaled = np.concatenate((sample, np.zeros((len(sample), 1))), axis=1).astype(np.float32)
    asked = near if same else graph_between(queries, scaled, neighbours)
    x = np.concatenate((rows, queries))
    target = np.concatenate((shares(near, 0.5 * neighbours), shares(asked, 0.0 if not same else 1.0)))
    return Router(*train_router(blank, x, target), norm2)


def graph_between(q: np.ndarray, x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """For each row of q, its ``k`` largest inner products in x, its own row left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(q), k), np.int64)
    for lo in range(0, len(q), block):
        s = q[lo:lo + block] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo:lo + block] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def part_count(rows: int, sampled: int, rows_per_part: int = 2048) -> int:
    """A power of two: about ``rows_per_part`` rows a part, and at least 32
    sampled rows for each part."""
    most = max(1, min(rows // rows_per_part, sampled // 32))
    return 1 << (most.bit_length() - 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _probes_for(index: DataFrame, queries: DataFrame, router: Router, parts: int, recall: float, asked: int,
                k: int) -> int:
    """Fewest likeliest parts that hold ``recall`` of the true neighbours of
    about ``asked`` queries, which are compared with every row."""
    if parts == 1:
        return 1
    n = max(1, queries.count())
    draw = F.pmod(F.xxhash64("c", F.lit("ann check")), F.lit(1_000_003)) / 1_000_003.0
    drawn = queries.where(draw < asked / n).select("c", "v").toArrow().sort_by("c").combine_chunks()
    if not len(drawn):
        return parts
    own, x = drawn["c"].to_numpy(), _matrix(drawn["v"].combine_chunks())
    shared = index.sparkSession.sparkContext.broadcast((own, x))

    def nearest(batches):
        own, x = shared.value
        best = None
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                near = x @ _matrix(s.column(2)).T
                near[own[:, None] == s.column(0).to_numpy()[None, :]] = -np.inf
                part = np.broadcast_to(s.column(3).to_numpy(), near.shape)
                if best is not None:
                    near, part = np.concatenate((best[0], near), axis=1), np.concatenate((best[1], part), axis=1)
                top = np.argsort(-near, axis=1)[:, :k]
                best = np.take_along_axis(near, top, axis=1), np.take_along_axis(part, top, axis=1)
        if best is not None:
            q = np.repeat(np.arange(len(x)), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[1].reshape(-1)), pa.array(best[0].reshape(-1))],
                                             names=["q", "part", "score"])

    true = (index.mapInArrow(nearest, "q long, part long, score double")
            .withColumn("r", F.expr("row_number() over (partition by q order by score desc, part)"))
            .where((F.col("r") <= k) & (F.col("score") > float("-inf"))).select("q", "part").toArrow())
    order = np.argsort(-router.logits(router.inputs(x, True)), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    at = rank[true["q"].to_numpy(), true["part"].to_numpy()]
    held = np.cumsum(np.bincount(at, minlength=parts)) / max(len(at), 1)
    return int(np.searchsorted(held, recall) + 1)


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
           recall: float = 0.95, check_queries: int = 256, sample_rows: int = 16384,
           block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose
    id is divisible by ``every``, among all other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    keep = k + 1
    # equal vectors: one class, named by its smallest id, with the ids that any result can need;
    # the ids are cut to the smallest in each of 64 shares first, so copies never meet in one task
    salted = rows.distinct().select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    cut = salted.withColumn("r", F.expr("row_number() over (partition by v, salt order by id)")).where(F.col("r") <= keep)
    ids = cut.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    classes = checkpoint(ids.select(F.col("ids")[0].alias("c"), "ids", "v"))
    n = classes.agg(F.count(F.lit(1)).alias("n"),
                    F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n["n"]:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample_rows / n["n"])
    draw = F.pmod(F.xxhash64("c", F.lit("ann sample")), F.lit(1_000_003)) / 1_000_003.0
    drawn = classes.where(draw < share).select("c", "v").toArrow().sort_by("c")["v"].combine_chunks()
    sample = _matrix(drawn) if len(drawn) else _matrix(classes.select("v").limit(1).toArrow()["v"].combine_chunks())
    parts = part_count(n["n"], len(sample))
    router = spark.sparkContext.broadcast(fit_router(sample, n["norm2"], parts))

    def assign(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                v = _matrix(s.column(2))
                part = router.value.logits(router.value.inputs(v, False)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*[s.column(i) for i in range(3)], pa.array(part)],
                                                 names=["c", "ids", "v", "part"])

    index = checkpoint(classes.mapInArrow(assign, "c long, ids array<long>, v array<double>, part long"))
    sizes = np.zeros(parts, np.int64)  # one number for each part
    for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["part"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // block_rows))

    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").distinct()
    queries = classes.join(asked.select("v").distinct(), "v", "left_semi").select("c", "v")

    probes = _probes_for(index, queries, router.value, parts, recall, check_queries, k)

    def route(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                z = router.value.logits(router.value.inputs(_matrix(s.column(1)), True))
                order = np.argsort(-z, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1) - sizes[order]
                # the likeliest parts, and further ones while those hold too few rows
                take = (np.arange(parts) < probes) | (held < 2 * keep)
                row, col = np.nonzero(take & (sizes[order] > 0))
                part = order[row, col]
                copies = blocks[part]
                row, part = np.repeat(row, copies), np.repeat(part, copies)
                block = np.arange(len(part)) - np.repeat(np.cumsum(copies) - copies, copies)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(row)), s.column(1).take(pa.array(row)), pa.array(part), pa.array(block)],
                    names=["c", "v", "part", "block"])

    routed = checkpoint(queries.mapInArrow(route, "c long, v array<double>, part long, block long"))
    load = np.zeros(parts, np.int64)
    for r in routed.where("block = 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        load[r["part"]] = r["n"]
    groups = np.maximum(1, -(-load // block_rows))

    def deal(column, counts):
        """counts[part], as a column (one number for each part)."""
        return F.element_at(F.array(*[F.lit(int(x)) for x in counts]), (column + 1).cast("int")) if parts <= 64 \
            else F.element_at(F.from_json(F.lit(str([int(x) for x in counts])), "array<bigint>"), (column + 1).cast("int"))

    stored = (index.select("part", F.pmod(F.xxhash64("c"), deal(F.col("part"), blocks)).alias("block"),
                           F.explode(F.sequence(F.lit(0).cast("long"), deal(F.col("part"), groups).cast("long") - 1)).alias("grp"),
                           "c", "ids", "v"))
    asking = routed.select("part", "block", F.pmod(F.xxhash64("c", F.lit(7)), deal(F.col("part"), groups)).alias("grp"),
                           "c", F.lit(None).cast("array<long>").alias("ids"), "v")
    both = stored.withColumn("q", F.lit(0)).unionByName(asking.withColumn("q", F.lit(1)))

    def rank(batches):
        """Streams (part, block, grp) runs: rows of the block first, then its queries."""
        at, held_v, held_ids, data, first_ids = None, [], [], None, None
        for b in batches:
            part, block, grp = (b.column(i).to_numpy() for i in range(3))
            q = b.column(6).to_numpy()
            v = _matrix(b.column(5))
            edge = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])
                                            | (grp[1:] != grp[:-1]) | (q[1:] != q[:-1])))
            out_q, out_s, out_i = [], [], []
            for lo, hi in zip(edge, np.append(edge[1:], len(part))):
                here = (part[lo], block[lo], grp[lo])
                if here != at:
                    at, held_v, held_ids, data = here, [], [], None
                if q[lo] == 0:
                    held_v.append(v[lo:hi])
                    held_ids.append(b.column(4).slice(lo, hi - lo))
                    data = None
                    continue
                if not held_v:
                    continue
                if data is None:
                    data = np.concatenate(held_v)
                    ids = pa.concat_arrays([x.cast(pa.list_(pa.int64())) for x in held_ids])
                    start, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                    first_ids = flat[start[:-1]]
                for s0 in range(lo, hi, 256):
                    x = v[s0:min(s0 + 256, hi)]
                    near = x @ data.T
                    m = min(keep, near.shape[1])
                    bound = -np.partition(-near, m - 1, axis=1)[:, m - 1]
                    for j in range(len(x)):
                        cand = np.flatnonzero(near[j] >= bound[j] - 1e-9 * max(1.0, abs(bound[j])))
                        exact = (data[cand] * x[j]).sum(axis=1)  # the same sum whatever the block
                        order = np.lexsort((first_ids[cand], -exact))
                        cand, exact = cand[order], exact[order]
                        num = start[cand + 1] - start[cand]
                        got = np.concatenate([flat[start[c]:start[c + 1]] for c in cand])
                        val = np.repeat(exact, num)
                        top = np.lexsort((got, -val))[:keep]
                        out_q.append(np.full(len(top), b.column(3)[s0 + j].as_py()))
                        out_s.append(val[top])
                        out_i.append(got[top])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_i, out_s)],
                                                 names=["c", "vec_id", "score"])

    found = (both.repartition("part", "block", "grp").sortWithinPartitions("part", "block", "grp", "q", "c")
             .select("part", "block", "grp", "c", "ids", "v", "q")
             .mapInArrow(rank, "c long, vec_id long, score double"))
    best = (found.withColumn("r", F.expr("row_number() over (partition by c order by score desc, vec_id)"))
            .where(F.col("r") <= keep).select("c", "vec_id", "score"))
    named = asked.join(classes.select("c", "v"), "v").select("query_id", "c")
    return (named.join(best, "c").where("query_id <> vec_id")
            .withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
