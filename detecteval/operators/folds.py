"""Grouped K-fold, leak checks, validation by group, fold choice.

Folds are a small table ``(seed, project, fold)``; train and test are the
predicates ``fold <> k`` and ``fold = k``. Groups go to the lightest fold, by
size descending. Groups of equal size are interchangeable for the loads, so the
driver only sees the *size classes* (n, number of groups): at most
``sqrt(2 * rows)`` of them, whatever the number of groups. Which group of a class
takes which place is a distributed rank by hash.
"""
from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import H, TWO32
from .sampling import stratified_take, take_k_by_hash

RANK_BUCKETS = 4096


def group_sizes(df: DataFrame, group_col: str = "project") -> DataFrame:
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"),
                                     F.sum("label").cast("long").alias("n_pos"))


def _class_cycles(classes: Sequence[tuple[int, int]], n_splits: int) -> list[tuple[int, list, list]]:
    """For each size class (n, number of groups), largest n first: the ranks at
    which another fold joins in, and the cycle of folds from there on.

    The r-th group of a class goes to the fold of the r-th smallest
    ``(load_f + j * n, f)``. From the value on at which a fold has been caught up
    with, it takes one group per round, so the folds form a cycle until the next
    fold joins: ``n_splits`` cycles describe a class of any number of groups.
    """
    loads = [0] * n_splits
    out = []
    for n, groups in sorted(classes, reverse=True):
        starts, cycles = [], []
        taken = [0] * n_splits
        active: list[int] = []
        for f in sorted(range(n_splits), key=lambda x: (loads[x], x)):
            # groups that the folds before this one take until it is the lightest
            before = {g: -((loads[g] - loads[f]) // n) + (g < f and (loads[f] - loads[g]) % n == 0) for g in active}
            start = sum(before.values())
            if start >= groups:
                break
            active.append(f)
            before[f] = 0
            cycle = sorted(active, key=lambda g: (loads[g] + before[g] * n, g))
            starts.append(start)
            cycles.append(cycle)
            rounds, rest = divmod(groups - start, len(cycle))
            taken = [0] * n_splits
            for at, g in enumerate(cycle):
                taken[g] = before[g] + rounds + (at < rest)
        loads = [load + n * t for load, t in zip(loads, taken)]
        out.append((n, starts, cycles))
    return out


def group_folds(df: DataFrame, n_splits: int = 5, seeds: Sequence[int] = (0,),
                group_col: str = "project") -> DataFrame:
    """Leave-groups-out fold table ``(seed, project, fold)``.

    Groups are taken by size descending, ties by seeded hash, and each goes
    to the currently lightest fold (lowest index on ties); one rule for all
    groups. Raises if there are fewer groups than folds.
    """
    sizes = group_sizes(df, group_col).select(group_col, "n")
    classes = [(r["n"], r["g"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("g")).collect()]
    n_groups = sum(g for _, g in classes)
    if n_groups < n_splits:
        raise ValueError(f"{n_splits} folds need as many groups, found {n_groups}")
    plan = _class_cycles(classes, n_splits)
    table = df.sparkSession.createDataFrame(pa.table({
        "n": pa.array([p[0] for p in plan], pa.int64()),
        "_starts": pa.array([p[1] for p in plan], pa.list_(pa.int64())),
        "_cycles": pa.array([p[2] for p in plan], pa.list_(pa.list_(pa.int32())))}))
    # Rank within (seed, class) by hash: counts of hash buckets give the offsets,
    # so the groups of one class spread over tasks.
    hashed = (sizes.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
              .withColumn("_h", H(F.col("seed"), "fold", F.col(group_col)))
              .withColumn("_b", F.floor(F.col("_h") / F.lit(TWO32 // RANK_BUCKETS))))
    by_bucket = Window.partitionBy("seed", "n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy("seed", "n", "_b").agg(F.count(F.lit(1)).alias("_c"))
               .select("seed", "n", "_b", F.coalesce(F.sum("_c").over(by_bucket), F.lit(0)).alias("_o")))
    inside = Window.partitionBy("seed", "n", "_b").orderBy("_h", group_col)
    ranked = (hashed.join(offsets, ["seed", "n", "_b"])
              .withColumn("_r", F.col("_o") + F.row_number().over(inside) - 1))
    # The class table is bounded by the number of distinct sizes, sqrt(2 * rows).
    placed = ranked.join(F.broadcast(table), "n").withColumn(
        "_s", F.size(F.filter("_starts", lambda x: x <= F.col("_r"))))
    cycle = F.element_at("_cycles", F.col("_s"))
    step = F.pmod(F.col("_r") - F.element_at("_starts", F.col("_s")), F.size(cycle)).cast("int")
    return placed.select("seed", group_col, F.element_at(cycle, step + 1).alias("fold"))


def assign_folds(df: DataFrame, folds: DataFrame, group_col: str = "project") -> DataFrame:
    """Rows x seeds with their fold; the fold table is per group, so it is
    joined on the group key (small side broadcast by size statistics)."""
    return df.join(folds, group_col)


def leak_check(assigned: DataFrame, group_col: str = "project") -> DataFrame:
    """Groups that fall in more than one fold of a seed; must be empty."""
    return (assigned.groupBy("seed", group_col)
            .agg(F.countDistinct("fold").alias("n_folds"))
            .filter(F.col("n_folds") > 1))


def fold_profile(df: DataFrame, folds: DataFrame, group_col: str = "project") -> DataFrame:
    """Per (seed, fold): test rows/groups/positive rate and train rows/groups
    as totals minus the fold (S13)."""
    g = group_sizes(df, group_col).join(folds, group_col)
    per = g.groupBy("seed", "fold").agg(
        F.sum("n").alias("n_test"), F.count(F.lit(1)).alias("test_projects"),
        F.sum("n_pos").alias("test_pos"))
    w = Window.partitionBy("seed")
    return per.select(
        "seed", "fold", "n_test", "test_projects",
        (F.col("test_pos") / F.col("n_test")).alias("test_pos_rate"),
        (F.sum("n_test").over(w) - F.col("n_test")).alias("n_train"),
        (F.sum("test_projects").over(w) - F.col("test_projects")).alias("train_projects"))


def fold_with_most_projects(folds: DataFrame) -> DataFrame:
    """Per seed, the fold with most distinct test groups, lowest fold on
    ties (J10)."""
    per = folds.groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n_projects"))
    return per.groupBy("seed").agg(
        F.max_by("fold", F.struct(F.col("n_projects"), -F.col("fold"))).alias("fold"),
        F.max("n_projects").alias("n_projects"))


def validation_groups_fraction(df: DataFrame, frac: float = 0.15, seed=0,
                               group_col: str = "project") -> DataFrame:
    """``round(frac * n_groups)`` groups (half-even, at least 1) by seeded
    hash (J6); returns ``(project, is_val)`` over the distinct groups."""
    from .sampling import take_k_global
    g = df.select(group_col).distinct()
    n = g.count()
    m = max(int(df.sparkSession.range(1).select(F.bround(F.lit(n) * F.lit(frac), 0)).collect()[0][0]), 1)
    h = g.withColumn("_h", H(seed, "val_frac", F.col(group_col)))
    return take_k_global(h, m, id_col=group_col, mark="is_val").select(group_col, "is_val")


def validation_by_fraction(df: DataFrame, frac: float = 0.15, seed=0, group_col: str = "project",
                           label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(training rows, validation rows) by :func:`validation_groups_fraction`.

    A threshold needs both classes: if the chosen groups hold only one, or no
    rows, all rows of ``df`` serve for validation; training rows stay the same.
    """
    groups = validation_groups_fraction(df, frac, seed, group_col).where("is_val").select(group_col)
    val = df.join(groups, group_col, "left_semi")
    n, pos = val.agg(F.count(F.lit(1)), F.sum(label)).first()
    return df.join(groups, group_col, "left_anti"), (val if n and 0 < pos < n else df)


def source_groups(df: DataFrame, folds: DataFrame, group_col: str = "project") -> DataFrame:
    """``(seed, k, group, n, n_pos)``: the groups outside fold k, for every fold k of
    the seed. The fold numbers are a list of n_splits, exploded beside each group."""
    ks = sorted(r[0] for r in folds.select("fold").distinct().collect())
    return (folds.join(group_sizes(df, group_col), group_col)
            .withColumn("k", F.explode(F.array(*[F.lit(int(x)) for x in ks])))
            .where("k <> fold").select("seed", "k", group_col, "n", "n_pos"))


def chosen_groups(src: DataFrame, size, salt: str, group_col: str = "project") -> DataFrame:
    """The first ``size`` (a Column over ``_n``, the number of groups) groups of every
    (seed, k) by hash; ranks come from bucket counts, so no task sees all groups."""
    quota = (src.groupBy("seed", "k").agg(F.count(F.lit(1)).alias("_n"))
             .select("seed", "k", size.cast("long").alias("_take")))
    hashed = src.withColumn("_h", H(F.col("seed") + F.col("k"), salt, F.col(group_col)))
    return take_k_by_hash(hashed, ["seed", "k"], quota, id_col=group_col, k_col="_take").drop("_h")


def cross_group_sides(df: DataFrame, folds: DataFrame, frac: float = 0.15, group_col: str = "project",
                      id_col: str = "row_id") -> DataFrame:
    """``(seed, fold, row_id, side)`` of leave-groups-out runs with J6 validation, all
    (seed, fold) in one job: the fold's rows test, ``round(frac * groups)`` of the other
    groups (half-even, at least 1) validate, the rest train. Where the validation
    groups hold one class only, all other rows of that (seed, fold) validate too."""
    src = source_groups(df, folds, group_col)
    take = F.greatest(F.bround(F.col("_n") * F.lit(frac), 0), F.lit(1))
    val = chosen_groups(src, take, "val_frac", group_col)
    short = (val.groupBy("seed", "k").agg(F.sum("n_pos").alias("_p"), F.sum("n").alias("_n"))
             .where("_p = 0 or _p = _n").select("seed", "k", F.lit(True).alias("_all")))
    marked = (src.select("seed", "k", group_col)
              .join(val.select("seed", "k", group_col, F.lit(True).alias("_val")), ["seed", "k", group_col], "left")
              .join(short, ["seed", "k"], "left"))
    sides = F.when(F.col("_val"), F.array(F.lit("val"))).when(
        F.col("_all"), F.array(F.lit("train"), F.lit("val"))).otherwise(F.array(F.lit("train")))
    rows = df.select(id_col, group_col)
    return (rows.join(marked, group_col).select("seed", F.col("k").alias("fold"), id_col, F.explode(sides).alias("side"))
            .unionByName(rows.join(folds, group_col).select("seed", "fold", id_col, F.lit("test").alias("side"))))


def validation_split(df: DataFrame, folds: DataFrame, group_col: str = "project",
                     min_pos: int = 3, fallback_test_size: float = 0.2) -> DataFrame:
    """Validation rows of every (seed, fold).

    The validation groups are ``max(1, n_src // 5)`` source groups ranked by
    ``H(seed+fold, 'val', project)``. If they hold fewer than ``min_pos``
    positives or a single class, the (seed, fold) falls back to a
    stratified ``fallback_test_size`` row split of its training rows.

    Returns the validation rows with every input column plus ``seed, fold``.
    """
    cols = df.columns
    src = source_groups(df, folds, group_col)
    vg = chosen_groups(src, F.greatest(F.floor(F.col("_n") / 5), F.lit(1)), "val", group_col)
    chk = vg.groupBy("seed", "k").agg(F.sum("n_pos").alias("_p"), F.sum("n").alias("_n"))
    chk = chk.withColumn("ok", (F.col("_p") >= min_pos) & (F.col("_p") < F.col("_n")))
    good = vg.join(chk.filter("ok").select("seed", "k"), ["seed", "k"])
    by_group = (df.join(good.select("seed", "k", group_col), group_col)
                .select("seed", F.col("k").alias("fold"), *cols))
    bad = chk.filter(~F.col("ok")).select("seed", "k")
    # Fallback rows: training rows of the failing (seed, k), stratified.
    tr = (df.join(folds, group_col).join(F.broadcast(bad), "seed")
          .filter(F.col("fold") != F.col("k"))
          .select("seed", F.col("k").alias("fold"), *cols))
    by_row = stratified_take(tr, ["seed", "fold"],
                             lambda n: F.ceil(n * F.lit(float(fallback_test_size))),
                             F.col("seed"), "val_rows")
    return by_group.unionByName(by_row.select(*by_group.columns))


def evaluation_sides(df: DataFrame, folds: DataFrame, group_col: str = "project",
                     min_pos: int = 3) -> DataFrame:
    """Input rows with ``seed, fold, side`` (side in {val, test}) (J7 + J4).

    A row is a test row once per seed and a validation row of some other
    folds; all (seed, fold) evaluations then run as one keyed job.
    """
    test = df.join(folds, group_col).withColumn("side", F.lit("test"))
    val = validation_split(df, folds, group_col, min_pos).withColumn("side", F.lit("val"))
    return test.unionByName(val.select(*test.columns))
