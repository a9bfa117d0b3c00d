"""Lexicographic order, ranks and key packing; checks of stored positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .grid import count_cells, with_starts

#: The order that breaks every tie.
FULL = ("frame", "scan", "tof", "cluster_id", "intensity", "line")
#: Rows between neighbours' comparison blocks.
BLOCK = 1 << 16


def with_positions(df: DataFrame, keys: tuple[str, ...], ties: tuple[str, ...] = (), name: str = "pos") -> DataFrame:
    """``df`` with each row's 0-based position in the order of ``keys`` then ``ties``.

    Rows are numbered inside the cells of the first two keys and shifted by the
    cells' starts, so no sort spans all rows.
    """
    order = (*keys, *(t for t in ties if t not in keys))
    cell = order[:2]
    starts = with_starts(count_cells(df, cell), cell[0], cell[1:]).select(*cell, F.col("start").alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*order[len(cell) :] or cell)) - 1
    return df.withColumn("_inside", inside).join(starts, list(cell)).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def sort_rows(df: DataFrame, keys: tuple[str, ...], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """A global sort, or with ``partition_by`` a shuffle on it and a sort inside partitions."""
    return df.repartition(*partition_by).sortWithinPartitions(*keys) if partition_by else df.orderBy(*keys)


def take(df: DataFrame, order: DataFrame, pos: str = "pos", at: str = "i") -> DataFrame:
    """The rows of ``df``, numbered by ``pos``, in the places that ``order`` (``at``, ``pos``) gives.

    A gather by a stored order: place ``at`` gets row ``pos``. A row may be taken
    often, or not at all; an order that names a missing row has no row there.
    """
    return order.select(at, pos).join(df, pos)


def grouped_rank(df: DataFrame, group: str, keys: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """``rank``: 0-based position inside the group."""
    order = Window.partitionBy(group).orderBy(*keys, *ties)
    return df.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def pack_keys(df: DataFrame, columns: tuple[str, ...], name: str = "packed") -> DataFrame:
    """One BIGINT of several non-negative keys, by Horner's rule with radix max + 1.

    Overflow of a BIGINT gives null instead of a wrong key.
    """
    tops = df.agg(*[(F.max(c).cast("long") + 1).alias(f"_radix_{c}") for c in columns[1:]])
    packed = reduce(lambda acc, c: F.try_add(F.try_multiply(acc, F.col(f"_radix_{c}")), F.col(c).cast("long")), columns[1:], F.col(columns[0]).cast("long"))
    return df.join(F.broadcast(tops)).withColumn(name, packed).drop(*[f"_radix_{c}" for c in columns[1:]])


def out_of_order(df: DataFrame, keys: tuple[str, ...], strict: bool = False, pos: str = "pos") -> DataFrame:
    """One row ``ok``: whether ``keys`` rise along the dense positions ``pos``; true for 0 or 1 rows.

    Neighbours meet in blocks of positions; the first row of a block is also
    sent to the block before it.
    """
    block = F.floor(F.col(pos) / BLOCK)
    rows = df.select(F.col(pos).alias("_pos"), F.struct(*keys).alias("_key"), F.explode(F.when((F.col(pos) % BLOCK == 0) & (F.col(pos) > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("_block"))
    before = F.lag("_key").over(Window.partitionBy("_block").orderBy("_pos"))
    bad = (before >= F.col("_key")) if strict else (before > F.col("_key"))
    return rows.select(bad.alias("_bad")).agg((F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)) == 0).alias("ok"))


def is_permutation(df: DataFrame, column: str) -> DataFrame:
    """One row ``ok``: whether the values are 0 … n-1, each once; true if empty."""
    n = F.count(F.lit(1))
    whole = (F.count_distinct(column) == n) & (F.coalesce(F.min(column), F.lit(0)) == 0) & (F.coalesce(F.max(column) + 1, F.lit(0)) == n)
    return df.agg(whole.alias("ok"))


def is_arange(df: DataFrame, pos: str, value: str, first: int = 0) -> DataFrame:
    """One row ``ok, at, found``: whether value = pos + first, else the first mismatch."""
    wrong: Column = F.when(~F.col(value).eqNullSafe(F.col(pos) + first), F.struct(F.col(pos).cast("long").alias("p"), F.col(value).cast("long").alias("v")))
    got = df.agg(F.min(wrong).alias("_w"))
    return got.select(F.col("_w").isNull().alias("ok"), F.col("_w.p").alias("at"), F.col("_w.v").alias("found"))
