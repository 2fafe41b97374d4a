"""Positions, gaps and runs in a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slab, about; there are as many slabs as that takes, and at most MOST of them.
SLAB_ROWS, MOST = 1 << 20, 1 << 14


def slabs_of(rows: int) -> int:
    return max(1, min(MOST, -(-rows // SLAB_ROWS)))


def with_slab(df: DataFrame, key: str, slabs: int | None = None, rows: int | None = None) -> DataFrame:
    """df with _slab, a number that grows with the numeric column `key`; slabs are of about equal size, and as many as the rows need.

    Cut points are approximate quantiles, computed once, so the slabs do not change when the
    plan is run again. A single slab needs none.
    """
    if slabs is None:
        slabs = slabs_of(df.count() if rows is None else rows)
    cuts = sorted(set(df.approxQuantile(key, [i / slabs for i in range(1, slabs)], 0.25 / slabs))) if slabs > 1 else []
    if not cuts:
        return df.withColumn("_slab", F.lit(0))
    return df.withColumn("_slab", F.coalesce(_cut_number(F.col(key), cuts), F.lit(-1)))


def _cut_number(key: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are not above key, by halving."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    if len(cuts) > 64:
        above = _cut_number(key, cuts[middle:]) + middle
        return F.when(key.isNull(), None).when(key < F.lit(cuts[middle]), _cut_number(key, cuts[:middle])).otherwise(above)
    return F.when(key.isNull(), None).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= key)))


def key_at(df: DataFrame, key: str, rank: int, slabs: int | None = None, rows: int | None = None) -> tuple[object, int, int]:
    """(key of the row that has this rank, from 1, in ascending order; how many rows lie before that key; how many have it).

    Only the slab that holds the rank is counted by key; nothing is sorted.
    """
    cut = with_slab(df.select(key), key, slabs, rows)
    sizes = sorted((r[0], r[1]) for r in cut.groupBy("_slab").agg(F.count("*")).collect())  # one row a slab
    before = 0
    for slab, n in sizes:
        if before + n >= rank:
            break
        before += n
    counted = cut.filter(F.col("_slab") == slab).groupBy(key).agg(F.count("*").alias("_n"))
    if len(sizes) == 1 or counted.count() <= SLAB_ROWS:
        over = Window.orderBy(key)  # one slab of distinct keys
        ranked = counted.withColumn("_upto", F.sum("_n").over(over))
        found = ranked.filter(F.col("_upto") >= rank - before).orderBy("_upto").first()
        return found[key], before + found["_upto"] - found["_n"], found["_n"]
    inner, earlier, same = key_at(cut.filter(F.col("_slab") == slab).select(key), key, rank - before, slabs_of(counted.count()) * 2)
    return inner, before + earlier, same


def with_position(df: DataFrame, key: str, *ties: str, slabs: int | None = None) -> DataFrame:
    """df with `position`, from 1, in the order of key and then ties: a window in each slab plus the sizes of earlier slabs."""
    cut = with_slab(df, key, slabs)
    sizes = cut.groupBy("_slab").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_slab")) - F.col("_n")).drop("_n")  # one row a slab
    own = F.row_number().over(Window.partitionBy("_slab").orderBy(key, *ties))
    return cut.join(F.broadcast(before), "_slab").withColumn("position", F.col("_before") + own).drop("_slab", "_before")


def run_sizes(df: DataFrame, key: str, gap: int, slabs: int | None = None) -> DataFrame:
    """(run, size): rows in the order of key, parted where it grows by more than gap.

    One window in each slab numbers the slab's runs; its first and last run are then joined with
    those of the slabs next to it, over one row a slab.
    """
    cut = with_slab(df.select(key), key, slabs)
    inside = Window.partitionBy("_slab").orderBy(key)
    fresh = (F.col(key) - F.lag(key).over(inside) > gap).cast("bigint")
    numbered = cut.withColumn("_run", F.sum(F.coalesce(fresh, F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("_slab", "_run").agg(F.count("*").alias("size"), F.min(key).alias("_from"), F.max(key).alias("_to"))
    edges = runs.groupBy("_slab").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_run").alias("_last"))
    whole = Window.orderBy("_slab")  # one row a slab
    apart = F.coalesce((F.col("_from") - F.lag("_to").over(whole) > gap).cast("bigint"), F.lit(0))
    # runs before a slab's first one: all earlier slabs' inner borders and the borders between slabs
    shift = edges.withColumn("_apart", apart).withColumn("_shift", F.sum(F.col("_apart")).over(whole) + F.coalesce(F.sum("_last").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = runs.select("_slab", "_run", "size").join(F.broadcast(shift.select("_slab", "_shift")), "_slab")
    return placed.groupBy((F.col("_run") + F.col("_shift")).alias("run")).agg(F.sum("size").cast("bigint").alias("size"))
