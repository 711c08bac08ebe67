"""Exact-size hash sampling, balancing and stratified splits.

All draws rank rows by ``(H(seed, salt, row_id), row_id)``; nothing depends
on partitioning. Exact-k never sorts a whole group in one task: rows are
counted per 2**(32-bucket_bits)-wide hash bucket, buckets wholly inside the
quota pass as they are, and only the one boundary bucket per key is ranked
(kernel A).
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import H
from ..session import checkpoint

_ALL = "all"
_EDGE = "edge"


def _bucket_plan(cnt: DataFrame, keys: Sequence[str], quota: DataFrame, k_col: str = "k") -> DataFrame:
    """``(keys, _b, _mode, _before, _k)`` of the buckets that a draw reaches, from their
    counts ``(keys, _b, _c)``: inside the quota, or the one at its edge."""
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return (cnt.withColumn("_cum", F.sum("_c").over(w))
            .join(quota.select(*keys, F.col(k_col).alias("_k")), keys)
            .withColumn("_before", F.col("_cum") - F.col("_c"))
            .withColumn("_mode", F.when(F.col("_cum") <= F.col("_k"), F.lit(_ALL))
                        .when(F.col("_before") < F.col("_k"), F.lit(_EDGE)))
            .filter(F.col("_mode").isNotNull())
            .select(*keys, "_b", "_mode", "_before", "_k"))


def take_k_by_hash(df: DataFrame, keys: Sequence[str], quota: DataFrame,
                   hash_col: str = "_h", id_col: str = "row_id", k_col: str = "k",
                   bucket_bits: int = 20, mark: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of every ``keys`` group in (hash, id) order.

    ``quota`` has columns ``keys + [k_col]``; groups without a quota row get
    k = 0. With ``mark`` set, every row is returned with a boolean column of
    that name instead of dropping the rest (no join back by row id needed).
    """
    keys = list(keys)
    cols = df.columns
    b = df.withColumn("_b", F.shiftright(F.col(hash_col), bucket_bits))
    cnt = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    plan = _bucket_plan(cnt, keys, quota, k_col)
    j = b.join(plan, keys + ["_b"], "left" if mark else "inner")
    w2 = Window.partitionBy(*keys, "_b").orderBy(F.col(hash_col), F.col(id_col))
    edge = (j.filter(F.col("_mode") == _EDGE)
            .withColumn("_r", F.row_number().over(w2)))
    if not mark:
        full = j.filter(F.col("_mode") == _ALL).select(*cols)
        return full.unionByName(edge.filter(F.col("_before") + F.col("_r") <= F.col("_k"))
                                .select(*cols))
    rest = (j.filter(F.col("_mode").isNull() | (F.col("_mode") == _ALL))
            .select(*cols, F.col("_mode").isNotNull().alias(mark)))
    return rest.unionByName(edge.select(*cols, (F.col("_before") + F.col("_r") <= F.col("_k"))
                                        .alias(mark)))


def take_k_global(df: DataFrame, k: int, hash_col: str = "_h", id_col: str = "row_id",
                  bucket_bits: int = 20, mark: str | None = None) -> DataFrame:
    """Exact-k over the whole frame without a global sort: the <= 4096
    bucket counts (a bounded list) are summed on the driver; buckets below
    the boundary pass, only the boundary bucket is ranked (by a window
    partitioned by bucket, never a single partition)."""
    b = df.withColumn("_b", F.shiftright(F.col(hash_col), bucket_bits))
    counts = sorted((r[0], r[1]) for r in b.groupBy("_b").count().collect())
    cum, edge, before = 0, None, 0
    for bk, c in counts:
        if cum + c >= k:
            edge, before = bk, cum
            break
        cum += c
    cols = df.columns
    if edge is None:  # k >= n: everything is taken
        return df.withColumn(mark, F.lit(True)) if mark else df
    need = int(k - before)
    w = Window.partitionBy("_b").orderBy(F.col(hash_col), F.col(id_col))
    e = b.filter(F.col("_b") == edge).withColumn("_r", F.row_number().over(w))
    if not mark:
        return b.filter(F.col("_b") < edge).select(*cols).unionByName(
            e.filter(F.col("_r") <= need).select(*cols))
    rest = b.filter(F.col("_b") != edge).select(*cols, (F.col("_b") < edge).alias(mark))
    return rest.unionByName(e.select(*cols, (F.col("_r") <= need).alias(mark)))


def _label_quota_table(spark, rows, label: str) -> DataFrame:
    return spark.createDataFrame([(int(l), int(k)) for l, k in rows], f"{label} int, k long")


def largest_remainder_py(counts: dict, total: int) -> dict:
    """Driver twin of ``largest_remainder_quota`` for a bounded label list."""
    n = sum(counts.values())
    fl = {l: (total * c) // n for l, c in counts.items()}
    rem = sorted(counts, key=lambda l: (-((total * counts[l]) % n), l))
    left = total - sum(fl.values())
    return {l: fl[l] + (1 if i < left else 0) for i, l in enumerate(rem)}


def class_counts(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_label"))


def largest_remainder_quota(counts: DataFrame, keys: Sequence[str], total: Column,
                            label: str = "label") -> DataFrame:
    """Split an integer ``total`` per group across labels in proportion to
    ``n_label`` by largest remainder (ties: smaller label first).

    ``counts`` has ``keys + [label, n_label, n]``; ``total`` is a Column over
    those. Returns ``keys + [label, k]``.
    """
    keys = list(keys)
    c = counts.withColumn("_t", total.cast("long"))
    c = (c.withColumn("_num", F.col("_t") * F.col("n_label"))
         .withColumn("_fl", F.floor(F.col("_num") / F.col("n")).cast("long"))
         .withColumn("_rem", F.col("_num") % F.col("n")))
    w = Window.partitionBy(*keys)
    wr = Window.partitionBy(*keys).orderBy(F.col("_rem").desc(), F.col(label))
    c = (c.withColumn("_left", F.col("_t") - F.sum("_fl").over(w))
         .withColumn("_rk", F.row_number().over(wr)))
    return c.select(*keys, label, (F.col("_fl") + F.when(F.col("_rk") <= F.col("_left"), 1)
                                   .otherwise(0)).cast("long").alias("k"))


def _with_group_n(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.withColumn("n", F.sum("n_label").over(Window.partitionBy(*keys)))


def stratified_take(df: DataFrame, keys: Sequence[str], size_fn, seed, salt: str,
                    label: str = "label", id_col: str = "row_id",
                    mark: str | None = None) -> DataFrame:
    """Exact stratified draw: group size ``size_fn(n)`` (a Column over ``n``)
    split across labels by largest remainder, hash-ranked within label."""
    keys = list(keys)
    hashed = df.withColumn("_h", H(seed, salt, F.col(id_col)))
    if not keys:
        # Global draw: the class counts are a bounded list (one row per label).
        cc = {r[0]: r[1] for r in class_counts(df, [], label).collect()}
        n = sum(cc.values())
        total = df.sparkSession.range(1).select(size_fn(F.lit(n)).cast("long")).collect()[0][0] if n else 0
        q = largest_remainder_py(cc, int(total)) if n else {}
        quota = _label_quota_table(df.sparkSession, q.items(), label)
        return take_k_by_hash(hashed, [label], quota, id_col=id_col, mark=mark).drop("_h")
    counts = _with_group_n(class_counts(df, keys, label), keys)
    quota = largest_remainder_quota(counts, keys, size_fn(F.col("n")), label)
    return take_k_by_hash(hashed, keys + [label], quota, id_col=id_col, mark=mark).drop("_h")


def hard_balance(df: DataFrame, seed=0, keys: Sequence[str] = (), label: str = "label",
                 id_col: str = "row_id", shuffle: bool = False) -> DataFrame:
    """k = min(#pos, #neg) rows of each class per group.

    The union of the two class samples is one filter over the input.
    ``shuffle`` orders by a seeded hash (a global sort: only when asked).
    """
    keys = list(keys)
    hashed = df.withColumn("_h", H(seed, "balance", F.col(id_col)))
    if not keys:
        cc = {r[0]: r[1] for r in class_counts(df, [], label).collect()}  # <= #labels rows
        k = min(cc.values()) if len(cc) >= 2 else 0
        quota = _label_quota_table(df.sparkSession, [(l, k) for l in cc], label)
        out = take_k_by_hash(hashed, [label], quota, id_col=id_col)
    else:
        counts = class_counts(df, keys, label)
        kmin = counts.groupBy(*keys).agg(F.min("n_label").alias("k"),
                                         F.count(F.lit(1)).alias("_nc"))
        kmin = kmin.withColumn("k", F.when(F.col("_nc") < 2, F.lit(0)).otherwise(F.col("k")))
        quota = counts.join(kmin, keys).select(*keys, label, "k")
        out = take_k_by_hash(hashed, keys + [label], quota, id_col=id_col)
    if shuffle:
        out = out.orderBy(H(seed, "shuffle", F.col(id_col)), F.col(id_col))
    return out.drop("_h")


def epoch_balance(df: DataFrame, epochs: int, base_seed: int = 0, vary: bool = True,
                  label: str = "label", id_col: str = "row_id") -> DataFrame:
    """Per-epoch balanced samples, seed = base+epoch (or constant)."""
    ep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    seed = (F.col("epoch") + F.lit(base_seed)) if vary else F.lit(base_seed)
    counts = class_counts(ep, ["epoch"], label)
    kmin = counts.groupBy("epoch").agg(F.min("n_label").alias("k"),
                                       F.count(F.lit(1)).alias("_nc"))
    kmin = kmin.withColumn("k", F.when(F.col("_nc") < 2, 0).otherwise(F.col("k")))
    quota = counts.join(kmin, "epoch").select("epoch", label, "k")
    hashed = ep.withColumn("_h", H(seed, "balance", F.col(id_col)))
    return take_k_by_hash(hashed, ["epoch", label], quota, id_col=id_col).drop("_h")


def random_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1, seed=0,
                 keys: Sequence[str] = (), label: str = "label",
                 id_col: str = "row_id") -> DataFrame:
    """Stratified train/val/test split; adds ``split`` in {train,val,test}.

    Test size is ``ceil(n*test_size)``; validation is
    ``ceil(rest*val_size/(1-test_size))`` of the rest; both per label by
    largest remainder, ranked by seeded hash. Rows are marked in place, so
    no join back by row id is needed.
    """
    keys = list(keys)
    t = stratified_take(df, keys, lambda n: F.ceil(n * F.lit(float(test_size))), seed,
                        "split_test", label, id_col, mark="_is_test")
    test = t.filter("_is_test").drop("_is_test").withColumn("split", F.lit("test"))
    rest = t.filter(~F.col("_is_test")).drop("_is_test")
    frac = val_size / (1.0 - test_size)
    v = stratified_take(rest, keys, lambda n: F.ceil(n * F.lit(frac)), seed,
                        "split_val", label, id_col, mark="_is_val")
    v = v.withColumn("split", F.when(F.col("_is_val"), "val").otherwise("train")).drop("_is_val")
    return test.unionByName(v)


def approx_split(df: DataFrame, test_size: float = 0.2, seed=0, id_col: str = "row_id") -> DataFrame:
    """Approximate split: hash fraction, no shuffle at all (J3 approximate)."""
    u = H(seed, "split_test", F.col(id_col)) / F.lit(4294967296.0)
    return df.withColumn("split", F.when(u < test_size, "test").otherwise("train"))


def downsample_positives(df: DataFrame, ratio: float = 0.05, seed=0,
                         keys: Sequence[str] = (), label: str = "label",
                         id_col: str = "row_id") -> DataFrame:
    """Keep all negatives and ``min(int(r/(1-r)*n_neg), n_pos)`` positives."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_neg"))
    quota = counts.select(*keys, F.least(
        F.floor(F.lit(ratio / (1 - ratio)) * F.col("_neg")).cast("long"),
        F.col("_pos")).alias("k"))
    pos = df.filter(F.col(label) == 1).withColumn("_h", H(seed, "downsample", F.col(id_col)))
    if keys:
        taken = take_k_by_hash(pos, keys, quota, id_col=id_col)
    else:
        k = quota.collect()[0]["k"] or 0  # one row
        taken = take_k_global(pos, int(k), id_col=id_col)
    return taken.drop("_h").unionByName(df.filter(F.col(label) == 0))


def calibration_draw(df: DataFrame, sizes: Sequence[int], seed, keys: Sequence[str] = (),
                     label: str = "label", id_col: str = "row_id", margin: int = 100) -> DataFrame:
    """Exact-size stratified calibration draws; adds ``cal_size`` and
    ``part`` in {cal, eval}; groups with n < k + margin are skipped (J9).

    The size list is a handful of literals, so the row expansion is bounded
    by ``len(sizes)``.
    """
    keys = list(keys)
    sz = df.withColumn("cal_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    n = sz.groupBy(*keys, "cal_size").agg(F.count(F.lit(1)).alias("_n"))
    ok = n.filter(F.col("_n") >= F.col("cal_size") + margin).select(*keys, "cal_size")
    sz = sz.join(ok, keys + ["cal_size"], "left_semi")
    out = stratified_take(sz, keys + ["cal_size"], lambda n_: F.col("cal_size"), seed,
                          "calibration", label, id_col, mark="_cal")
    return out.withColumn("part", F.when(F.col("_cal"), "cal").otherwise("eval")).drop("_cal")


def calibration_rows(df: DataFrame, sizes: Sequence[int], seed, keys: Sequence[str], label: str = "label",
                     id_col: str = "row_id", margin: int = 100, bucket_bits: int = 20) -> DataFrame:
    """The ``cal`` rows of :func:`calibration_draw`, with ``cal_size``. Only bucket counts
    are multiplied by the sizes; rows of buckets that no draw reaches go no further.

    The plan is broadcast: at most ``sum of sizes`` buckets a group, and one at each edge."""
    keys = list(keys)
    kk = keys + ["cal_size"]
    rows = (df.withColumn("_h", H(seed, "calibration", F.col(id_col)))
            .withColumn("_b", F.shiftright(F.col("_h"), bucket_bits)))
    cells = checkpoint(rows.groupBy(*keys, label, "_b").agg(F.count(F.lit(1)).alias("_c")))
    cells = cells.withColumn("cal_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    ok = (cells.groupBy(*kk).agg(F.sum("_c").alias("_n"))
          .filter(F.col("_n") >= F.col("cal_size") + margin).select(*kk))
    cells = cells.join(ok, kk, "left_semi")
    counts = _with_group_n(cells.groupBy(*kk, label).agg(F.sum("_c").alias("n_label")), kk)
    plan = _bucket_plan(cells, kk + [label], largest_remainder_quota(counts, kk, F.col("cal_size"), label))
    near = rows.join(F.broadcast(checkpoint(plan)), keys + [label, "_b"])
    w = Window.partitionBy(*kk, label, "_b").orderBy("_h", id_col)
    edge = (near.filter(F.col("_mode") == _EDGE).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_before") + F.col("_r") <= F.col("_k")))
    cols = [*df.columns, "cal_size"]
    return near.filter(F.col("_mode") == _ALL).select(*cols).unionByName(edge.select(*cols))


def sample_k(df: DataFrame, k: int, seed=0, id_col: str = "row_id") -> DataFrame:
    """Exactly ``k`` rows without replacement."""
    hashed = df.withColumn("_h", H(seed, "sample", F.col(id_col)))
    return take_k_global(hashed, int(k), id_col=id_col).drop("_h")


def shuffle_rows(df: DataFrame, seed=0, id_col: str = "row_id") -> DataFrame:
    """Full seeded shuffle: a range-partitioned global sort by hash."""
    return df.orderBy(H(seed, "shuffle", F.col(id_col)), F.col(id_col))
