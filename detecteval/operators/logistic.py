"""Logistic regressions of many configurations in one job (M1, M2, M5, M7).

A *task* is a set of training rows with its own TF-IDF vocabulary (a fold, a
balanced sample); a *fit* is a task with class weights. ``keyed_tfidf`` builds
the features of all tasks in one pass, ``shared_tfidf`` keeps them once a row for all
tasks, and ``fit_keyed`` advances all fits together: every step is one job that gives
each fit the loss and the gradient at its own point or a product with its curvature,
and Newton steps by conjugate gradients are array arithmetic on the driver. Driver and
tasks hold coefficients by fit and term of the vocabularies, whatever the number of
rows; steps re-read the checkpointed features.

The loss is ``|w|^2 / (2 C) + sum of weight * log-loss`` with a free intercept, so
the optimum is unique and the solver only decides how soon it is met.
"""
from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, written
from .models import term_counts

SALTS = 32
BLOCK = 1 << 16  # coefficients in one row of a gradient
CELLS = 1 << 21  # products held at once by a task
PART_CELLS = 1 << 23  # cells of a task's pieces
WIDE = 1 << 17  # numbers of a sum over terms held at once
TOGETHER = 512  # rows of the same fits that get pieces of their own


def keyed_vocabulary(counts: DataFrame, trained: DataFrame, max_features: int, id_col: str = "row_id") -> DataFrame:
    """``(task, term, idx, idf)``: for each task the ``max_features`` terms that its
    training rows hold most often (ties by term), numbered by term.

    A term's sums for all tasks stand in one row; only terms that reach the count of a
    task's last place are ranked."""
    n = {r[0]: r[1] for r in trained.groupBy("task").agg(F.count(F.lit(1))).collect()}  # one row per task
    tasks = sorted(n)
    own = trained.groupBy(id_col).agg(F.collect_list("task").alias("_l")).select(
        id_col, F.array(*[F.array_contains("_l", F.lit(t)) for t in tasks]).cast("array<boolean>").alias("_in"))
    sums = [F.struct(F.lit(t).alias("task"), F.lit(n[t]).alias("_n"), F.sum(F.when(F.col("_in")[i], F.col("tf"))).alias("_cnt"),
                     F.count(F.when(F.col("_in")[i], 1)).alias("_df")) for i, t in enumerate(tasks)]
    kind = f"array<struct<task:{dict(trained.dtypes)['task']},_n:bigint,_cnt:bigint,_df:bigint>>"
    stats = written(counts.join(own, id_col).groupBy("term").agg(F.array(*sums).cast(kind).alias("_s"))
                    .select("term", F.filter("_s", lambda x: x["_df"] > 0).alias("_s")))
    stats = stats.select("term", F.explode("_s").alias("_s")).select("term", "_s.*")
    by_count = Window.partitionBy("task").orderBy(F.desc("_cnt"))
    last = (stats.groupBy("task", "_cnt").agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_before", F.sum("_c").over(by_count) - F.col("_c")).where(F.col("_before") < max_features)
            .groupBy("task").agg(F.min("_cnt").alias("_last")))
    order = [F.desc("_cnt"), F.asc("term")]
    best = (stats.join(F.broadcast(last), "task").where("_cnt >= _last").drop("_last")  # one row per task
            .withColumn("_s", F.pmod(F.xxhash64("term"), F.lit(SALTS))))
    for keys in (["task", "_s"], ["task"]):  # first inside hash buckets: no task sees all terms
        best = (best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
                .where(F.col("_r") <= max_features))
    place = F.row_number().over(Window.partitionBy("task").orderBy("term")) - 1
    idf = F.ln((F.lit(1) + F.col("_n")).cast("double") / (F.lit(1.0) + F.col("_df"))) + F.lit(1.0)
    return best.select("task", "term", place.alias("idx"), idf.alias("idf"))


def _keyed_terms(texts: DataFrame, trained: DataFrame, max_features: int, text_col: str, id_col: str
                 ) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """The terms of all rows for all tasks: ``(row_id, _t, _tf)`` with each row's known terms
    (numbers that rise as the terms do) and counts, the vocabulary of each task as arrays over
    the numbers (place in the task's own vocabulary or -1, idf or 0), and how many numbers."""
    counts = checkpoint(term_counts(texts, text_col, id_col))
    known = keyed_vocabulary(counts, trained, max_features, id_col).toArrow()
    names = known["term"].to_pylist()
    terms = sorted(set(names), key=lambda x: x.encode())  # as Spark orders them: idx rises with the number
    number = {t: i for i, t in enumerate(terms)}
    at, many = np.array([number[t] for t in names], np.int64), len(terms)
    task_of, idx_of, idf_of = (known[c].to_numpy() for c in ("task", "idx", "idf"))
    books = {}
    for t in np.unique(task_of):
        place, idf = np.full(many, -1, np.int32), np.zeros(many)
        mine = task_of == t
        place[at[mine]], idf[at[mine]] = idx_of[mine], idf_of[mine]
        books[int(t)] = place, idf
    numbered = texts.sparkSession.createDataFrame(list(enumerate(terms)), "_t int, term string")
    entries = (counts.join(F.broadcast(numbered), "term").groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("_t", "tf"))).alias("_e"))
               .select(id_col, F.col("_e._t").alias("_t"), F.col("_e.tf").alias("_tf")))
    return entries, books, many


def _with_terms(members: DataFrame, entries: DataFrame, id_col: str) -> DataFrame:
    return members.join(entries, id_col, "left").withColumns({
        "_t": F.coalesce("_t", F.array().cast("array<int>")), "_tf": F.coalesce("_tf", F.array().cast("array<bigint>"))
    }).select(*members.columns, "_t", "_tf")


def keyed_tfidf(texts: DataFrame, members: DataFrame, max_features: int = 10_000, text_col: str = "func",
                id_col: str = "row_id") -> DataFrame:
    """``members`` (task, row_id, train and any other columns) with ``idx`` and ``val``,
    the row's L2-normalised TF-IDF under the vocabulary of its task, in the order of
    ``idx``; both empty for rows without a term of it.

    A row's terms are collected once, whatever the number of its tasks. The driver and
    each Python task hold the vocabularies: ``tasks x max_features`` terms at most."""
    trained = members.where("train").select("task", id_col).distinct()
    entries, books, many = _keyed_terms(texts, trained, max_features, text_col, id_col)
    shared = texts.sparkSession.sparkContext.broadcast(books)
    keep = members.columns

    def weigh(batches):
        for batch in batches:
            column = {c: batch.column(c) for c in (*keep, "_t", "_tf")}
            task = column["task"].to_numpy(zero_copy_only=False)
            for t in np.unique(task):
                rows = np.flatnonzero(task == t)
                (off, term), (_, tf) = (_lists(column[c].take(pa.array(rows))) for c in ("_t", "_tf"))
                term, tf = term[off[0]:off[-1]], tf[off[0]:off[-1]]
                place, idf = shared.value.get(int(t)) or (np.full(many, -1, np.int32), np.zeros(many))
                row = np.repeat(np.arange(len(rows)), np.diff(off))
                known = place[term] >= 0
                row, term, tf = row[known], term[known], tf[known]
                val = (1.0 + np.log(tf.astype(np.float64))) * idf[term]
                val = val / np.sqrt(np.bincount(row, weights=val * val, minlength=len(rows)))[row]
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(rows))))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [column[c].take(pa.array(rows)) for c in keep]
                    + [pa.ListArray.from_arrays(offsets, pa.array(place[term])), pa.ListArray.from_arrays(offsets, pa.array(val))],
                    names=[*keep, "idx", "val"])
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    return _with_terms(members, entries, id_col).mapInArrow(
        weigh, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", idx array<int>, val array<double>")


def shared_tfidf(texts: DataFrame, members: DataFrame, trained: DataFrame, max_features: int = 10_000,
                 text_col: str = "func", id_col: str = "row_id") -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """The TF-IDF of :func:`keyed_tfidf` with a row's terms stored once for all its tasks.

    ``members``: row_id, an array ``tasks`` and any other columns; ``trained``: (task, row_id).
    Returns ``members`` with ``idx``, ``val`` (sublinear counts over the terms of all
    vocabularies) and ``scale`` (for each of ``tasks`` one over the norm of the row's weights),
    then each task's idf over ``idx`` (0 for terms it does not have) and the bound of ``idx``:
    the weight of a term for a task is ``val * idf * scale``."""
    entries, books, many = _keyed_terms(texts, trained, max_features, text_col, id_col)
    idfs = {t: idf for t, (_, idf) in books.items()}
    shared = texts.sparkSession.sparkContext.broadcast(idfs)
    keep = members.columns

    def weigh(batches):
        for batch in batches:
            (off, term), (_, tf), (tat, task) = (_lists(batch.column(c)) for c in ("_t", "_tf", "tasks"))
            term, tf, task = term[off[0]:off[-1]], tf[off[0]:off[-1]], task[tat[0]:tat[-1]]
            val = 1.0 + np.log(tf.astype(np.float64))
            row, owner = (np.repeat(np.arange(batch.num_rows), np.diff(x)) for x in (off, tat))
            scale = np.zeros(len(task))
            for t in np.unique(task):
                if int(t) in shared.value:
                    u = val * shared.value[int(t)][term]
                    norm = np.sqrt(np.bincount(row, weights=u * u, minlength=batch.num_rows))
                    mine = task == t
                    scale[mine] = (1 / np.where(norm > 0, norm, np.inf))[owner[mine]]
            terms, tasks = (pa.array(x - x[0], pa.int32()) for x in (off, tat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.ListArray.from_arrays(terms, pa.array(term, pa.int32())),
                                                   pa.ListArray.from_arrays(terms, pa.array(val)),
                                                   pa.ListArray.from_arrays(tasks, pa.array(scale))],
                names=[*keep, "idx", "val", "scale"])
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    rows = _with_terms(members, entries, id_col).mapInArrow(
        weigh, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", idx array<int>, val array<double>, scale array<double>")
    return rows, idfs, many


# -- one pass over the rows ----------------------------------------------------------

def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)


def _pairs(batch: pa.RecordBatch, width: int):
    """(rows, fits, cells of the coefficients, values, pair of each cell) of the
    batch's (row, fit) pairs, about ``CELLS`` cells at a time. The batch holds
    idx, val and fit as its first columns."""
    (at, idx), (_, val), (fat, fit) = (_lists(batch.column(c)) for c in ("idx", "val", "fit"))
    terms, fits = np.diff(at), np.diff(fat)
    row = np.repeat(np.arange(batch.num_rows), fits)
    own = fit[fat[0]:fat[-1]].astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(terms[row])))
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + CELLS, side="right")) - 1)
        n = terms[row[lo:hi]]
        pair = np.repeat(np.arange(hi - lo), n)
        flat = np.arange(len(pair)) - (np.cumsum(n) - n)[pair] + at[row[lo:hi]][pair]
        yield slice(lo, hi), row[lo:hi], own[lo:hi], own[lo:hi][pair] * width + idx[flat], val[flat], pair
        lo = hi


def _margins(w: np.ndarray, fits, cells, values, pair) -> np.ndarray:
    return np.bincount(pair, weights=values * w.ravel()[cells], minlength=len(fits)) + w[fits, -1]


#: A piece of rows, as the bytes of numpy arrays: ``order`` sorts its cells by ``idx``; label, w
#: and scale stand by row, w and scale for each fit of the piece (w is 0 where a row does not train it).
_PIECE = {"fits": np.int32, "at": np.int64, "idx": np.int32, "val": np.float64, "order": np.int32, "label": np.float64,
          "w": np.float64, "scale": np.float64}


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """The rows in pieces of at most about ``CELLS`` cells: steps read plain arrays and take
    nothing apart. Rows that train the same fits stand together where a batch has
    ``TOGETHER`` of them, the others share pieces. Pieces are dealt out evenly."""
    def run(batches):
        for batch in batches:
            (at, idx), (_, val), (fat, fit), (_, w), (_, scale) = (
                _lists(batch.column(c)) for c in ("idx", "val", "fit", "w", "scale"))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            alike: dict[bytes, list[int]] = {}
            for r in range(batch.num_rows):
                alike.setdefault(fit[fat[r]:fat[r + 1]].astype(np.int32).tobytes(), []).append(r)
            kinds = [own for own in alike.values() if len(own) >= TOGETHER]
            kinds.append([r for own in alike.values() if len(own) < TOGETHER for r in own])
            for own in map(np.array, filter(None, kinds)):
                ends = np.cumsum(at[own + 1] - at[own])
                lo = 0
                while lo < len(own):
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
                    mine = own[lo:hi]
                    start, flat = _spans(at, mine)
                    many, pair = _spans(fat, mine)
                    fits, place = np.unique(fit[pair], return_inverse=True)
                    weight, size = np.zeros((2, len(mine), len(fits)))
                    row = np.repeat(np.arange(len(mine)), np.diff(many))
                    weight[row, place], size[row, place] = w[pair], scale[pair]
                    piece = {"fits": fits, "at": start, "idx": idx[flat], "val": val[flat],
                             "order": np.argsort(idx[flat], kind="stable"), "label": label[mine], "w": weight, "scale": size}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([piece[c].astype(kind).tobytes()], pa.binary()) for c, kind in _PIECE.items()], names=list(_PIECE))
                    lo = hi
    return rows.select("label", "idx", "val", "fit", "w", "scale").mapInArrow(
        run, ", ".join(f"{c} binary" for c in _PIECE)).repartition(parts)


def _spans(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, positions) of the cells of ``rows`` of lists with the offsets ``at``."""
    n = at[rows + 1] - at[rows]
    start = np.concatenate(([0], np.cumsum(n)))
    return start, np.arange(start[-1]) + np.repeat(at[rows] - start[:-1], n)


def _sums(table: np.ndarray, pick: np.ndarray, factor: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of ``factor * table[pick]`` over each of the spans that begin at ``start`` (none
    empty), for all columns of ``table`` at once; ``WIDE`` numbers are held at a time."""
    out = np.empty((len(start), table.shape[1]))
    at = np.append(start, len(pick))
    lo, most = 0, max(1, WIDE // table.shape[1])
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        cells = table.take(pick[at[lo]:at[hi]], axis=0)
        cells *= factor[at[lo]:at[hi], None]
        np.add.reduceat(cells, at[lo:hi] - at[lo], axis=0, out=out[lo:hi])
        lo = hi
    return out


def _totals(pieces: DataFrame, at: tuple[np.ndarray, np.ndarray], open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, vector) of every fit marked in ``open_``, without the penalty; ``at`` holds the fits'
    points and directions. The vector is the gradient at the point or, for a fit with a
    direction other than 0, the product of the curvature at the point with the direction
    (and no loss). Each task adds up its pieces, blocks of numbers are then added up over the tasks."""
    n, width = at[0].shape
    turned = at[1].any(axis=1)
    shared = pieces.sparkSession.sparkContext.broadcast((at[0].T.copy(), at[1][turned].T.copy(), turned, open_))

    def add(piece, total, losses):
        points, directions, turned, open_ = shared.value
        own = np.flatnonzero(open_[piece["fits"]])
        if not len(own):
            return
        fits, y, start = piece["fits"][own], piece["label"][:, None], piece["at"]
        s, scale = (piece[c].reshape(len(y), -1)[:, own] for c in ("w", "scale"))
        full, bent = np.flatnonzero(np.diff(start)), turned[fits]
        table = np.hstack([points[:, fits], directions[:, (np.cumsum(turned) - 1)[fits[bent]]]])
        z = np.zeros((len(y), table.shape[1]))
        if len(full):
            z[full] = _sums(table[:-1], piece["idx"], piece["val"], start[full])
        z = z * np.hstack([scale, scale[:, bent]]) + table[-1]
        z, turn = z[:, :len(own)], z[:, len(own):]
        p = np.exp(-np.logaddexp(0, -z))
        rest = s * (p - y)
        rest[:, bent] = (s * p * np.exp(-np.logaddexp(0, z)))[:, bent] * turn
        flat = ~bent
        losses[fits[flat]] += (s * (np.logaddexp(0, z) - y * z)).sum(axis=0)[flat]
        total[-1, fits] += rest.sum(axis=0)
        if len(full):
            order = piece["order"]
            by = piece["idx"][order]
            first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
            row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(start))[order]
            total[by[first][:, None], fits] += _sums(rest * scale, row, piece["val"][order], first)

    def local(batches):
        total, losses = np.zeros((width, n)), np.zeros(n)
        for batch in batches:
            for i in range(batch.num_rows):
                add({c: np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in _PIECE.items()}, total, losses)
        flat = np.append(total.T.ravel(), losses)
        yield from _blocks({k // BLOCK: flat[k:k + BLOCK] for k in range(0, len(flat), BLOCK)})

    def merged(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data)
                total[k] = total[k] + part if k in total else part
        yield from _blocks(total)

    def _blocks(total):
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([x.tobytes() for x in total.values()], pa.binary())],
                                         names=["block", "data"])
    blocks = -(-(n * width + n) // BLOCK)
    got = (pieces.mapInArrow(local, "block int, data binary")
           .repartition(blocks, "block").mapInArrow(merged, "block int, data binary").collect())
    shared.destroy()
    total = np.concatenate([np.frombuffer(r.data) for r in sorted(got, key=lambda r: r.block)])
    return total[n * width:], total[:n * width].reshape(n, width)


# -- solver ----------------------------------------------------------------------------

def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return (a * b).sum()  # BLAS would wake all cores of the driver for it


def _newton(start: np.ndarray, tol: float, max_steps: int):
    """Newton steps with halved lengths for one fit, as a generator: it yields a point and a
    direction or None, is sent the loss and the gradient or curvature product there, and
    returns the point whose largest gradient entry is ``tol`` or less. A step solves for its
    direction by conjugate gradients, the closer the smaller the gradient has become."""
    w = start
    f, g = yield w, None
    first, still = max(np.sqrt(_dot(g, g)), 1e-300), 0
    for _ in range(max_steps):
        if np.abs(g).max() <= tol:
            break
        size = _dot(g, g)
        goal = size * min(0.1, np.sqrt(np.sqrt(size) / first)) ** 2
        d, r = np.zeros_like(w), -g
        p, rr = r, size
        for _ in range(len(w)):
            if rr <= goal:
                break
            bent = (yield w, p)[1]
            curve = _dot(p, bent)
            if not curve > 0:
                break
            d, r = d + rr / curve * p, r - rr / curve * bent
            rr, old = _dot(r, r), rr
            p = r + rr / old * p
        if not d.any():
            d = -g
        slope, step = _dot(g, d), 1.0
        for _ in range(50):
            ft, gt = yield w + step * d, None
            if ft <= f + 1e-4 * step * slope + 1e-13 * abs(f):
                break
            step /= 2
        else:
            break  # it can go no lower: rounding
        same = f - ft <= 1e-13 * abs(f) and np.abs(gt).max() > np.abs(g).max() / 2
        still = still + 1 if same else 0
        w, f, g = w + step * d, ft, gt
        if still == 3:
            break  # neither loss nor gradient fall any more: rounding
    return w


def minimise(value: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray,
             tol: float, max_steps: int) -> np.ndarray:
    """:func:`_newton` over all rows of ``start`` side by side: ``value`` takes points,
    directions (0 where the gradient is asked for) and a mark of the rows that ask, and gives
    losses and vectors. A row rests once its largest gradient entry is ``tol`` or less."""
    out, runs, asked = start.copy(), {}, {}
    for i, row in enumerate(start):
        runs[i] = _newton(row, tol, max_steps)
        asked[i] = next(runs[i])
    while runs:
        open_ = np.zeros(len(start), bool)
        open_[list(runs)] = True
        points, directions = out.copy(), np.zeros_like(out)
        for i in runs:
            points[i] = asked[i][0]
            if asked[i][1] is not None:
                directions[i] = asked[i][1]
        loss, vector = value(points, directions, open_)
        for i in list(runs):
            try:
                asked[i] = runs[i].send((loss[i], vector[i]))
            except StopIteration as end:
                out[i] = end.value
                del runs[i]
    return out


def fit_keyed(rows: DataFrame, fits: int, size: int, c: float = 1.0, tol: float = 1e-4, max_steps: int = 1000,
              factors: np.ndarray | None = None) -> np.ndarray:
    """Coefficients ``[fits, size + 1]`` (the intercept last) of ``fits`` regressions.

    ``rows``: label, idx, val, and the fits that the row trains (``fit`` array<int>)
    with its weight in each (``w`` array<double>). ``size`` bounds ``idx``; what the driver
    holds does not grow with the rows. Where fits see a row's terms by weights of their own,
    ``rows`` has a ``scale`` for each of ``fit`` and ``factors`` is ``[fits, size]``: the row's
    feature is ``val * factors * scale``. A fit without rows gets zeros."""
    scale = F.col("scale") if "scale" in rows.columns else F.transform("fit", lambda x: F.lit(1.0))
    rows = rows.select(F.col("label").cast("int").alias("label"), "idx", "val", "fit", "w", scale.alias("scale"))
    cells = rows.agg(F.sum(F.size("idx").cast("long"))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-cells // PART_CELLS))
    pieces = checkpoint(_packed(rows, parts))
    plain = np.append(np.ones(size), 0) / c
    factor = np.ones((fits, size + 1))
    if factors is not None:
        factor[:, :-1] = factors

    def value(points, directions, open_):
        loss, vector = _totals(pieces, (points * factor, directions * factor), open_)
        turned = directions.any(axis=1)
        penalty = np.where(turned, 0, (points * points * plain).sum(axis=1) / 2)
        return loss + penalty, vector * factor + plain * np.where(turned[:, None], directions, points)
    return minimise(value, np.zeros((fits, size + 1)), tol, max_steps)


def score_keyed(rows: DataFrame, coefficients: np.ndarray, keep: Sequence[str], each: Sequence[str] = ()) -> DataFrame:
    """One row per input row and fit of its ``fit`` array: ``keep``, the element of each array
    of ``each`` that goes with the fit, fit, margin, score. ``scale``, if there, is such an
    array and multiplies the sum over the terms."""
    shared = rows.sparkSession.sparkContext.broadcast(coefficients)
    keep, each = list(keep), list(each)
    scaled = ["scale"] if "scale" in rows.columns else []

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = {c: batch.column(c).flatten() for c in (*each, *scaled)}
            size = flat["scale"].to_numpy() if scaled else np.ones(len(batch.column("fit").flatten()))
            for own, row, fits, cells, values, pair in _pairs(batch, shared.value.shape[1]):
                z = _margins(shared.value, fits, cells, values * size[own][pair], pair)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(row)) for c in keep]
                    + [flat[c].slice(own.start, own.stop - own.start) for c in each]
                    + [pa.array(fits.astype(np.int32)), pa.array(z), pa.array(np.exp(-np.logaddexp(0, -z)))],
                    names=[*keep, *each, "fit", "margin", "score"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kinds |= {c: rows.schema[c].dataType.elementType.simpleString() for c in each}
    return rows.select("idx", "val", "fit", *scaled, *keep, *each).mapInArrow(
        run, ", ".join(f"{c} {kinds[c]}" for c in (*keep, *each)) + ", fit int, margin double, score double")


def run_protocol(texts: DataFrame, sides: DataFrame, plan: DataFrame, max_features: int = 10_000, tol: float = 1e-4,
                 text_col: str = "func", id_col: str = "row_id") -> DataFrame:
    """Fit every configuration and score its other rows (M7): the prediction table
    ``(fit, row_id, label, side, margin, score)`` of all of them.

    ``texts``: row_id, label and text. ``sides``: (task, row_id, side), side train,
    val or test; a row may stand on several sides. ``plan``: (fit, task, w1), fits
    numbered from 0, w1 the weight of positives; a bounded list. A row's terms are stored
    once, beside the list of its fits."""
    of = [(r["fit"], r["task"]) for r in plan.select("fit", "task").collect()]
    per_task = plan.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("fit", "w1"))).alias("_p"))
    own = (sides.groupBy("task", id_col).agg(F.collect_list("side").alias("_s"))
           .join(F.broadcast(per_task), "task").select(id_col, "task", "_s", F.explode("_p").alias("_f"))
           .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_f.fit", "task", "_f.w1", "_s"))).alias("_m")))
    members = checkpoint(own.join(texts.select(id_col, "label"), id_col)
                         .select(id_col, "label", F.col("_m.task").alias("tasks"), "_m"))
    trained = (members.select(id_col, F.explode("_m").alias("_m")).where(F.array_contains("_m._s", "train"))
               .select("_m.task", id_col).distinct())
    rows, idfs, size = shared_tfidf(texts, members, trained, max_features, text_col, id_col)
    rows = checkpoint(rows.withColumn("_m", F.zip_with("_m", "scale", lambda m, x: F.struct(
        m["fit"].alias("fit"), m["w1"].alias("w1"), m["_s"].alias("s"), x.alias("scale")))).drop("tasks", "scale"))
    train = F.filter("_m", lambda m: F.array_contains(m["s"], "train"))
    other = F.flatten(F.transform("_m", lambda m: F.transform(
        F.array_sort(F.array_remove(m["s"], "train")),
        lambda side: F.struct(m["fit"].alias("fit"), side.alias("side"), m["scale"].alias("scale")))))
    learnt = (rows.withColumn("_m", train).where(F.size("_m") > 0)
              .select("label", "idx", "val", F.col("_m.fit").alias("fit"), F.col("_m.scale").alias("scale"),
                      F.transform("_m", lambda m: F.when(F.col("label") == 1, m["w1"]).otherwise(1.0)).alias("w")))
    factors = np.zeros((len(of), size))
    for fit, task in of:
        factors[fit] = idfs.get(task, 0)
    coefficients = fit_keyed(learnt, len(of), size, tol=tol, factors=factors)
    coefficients[:, :-1] *= factors
    judged = rows.withColumn("_m", other).where(F.size("_m") > 0).select(
        id_col, "label", "idx", "val", *[F.col(f"_m.{c}").alias(c) for c in ("fit", "side", "scale")])
    scored = score_keyed(judged, coefficients, [id_col, "label"], ["side"])
    return scored.select(id_col, "label", "side", "fit", "margin", "score")
