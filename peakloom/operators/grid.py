"""Counts, sums and prefix sums over cells, and their dense and long forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

CELL = ("frame", "scan")
#: Bits of an integer key inside one block of a running sum.
BLOCK_BITS = 12


def count_cells(df: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Rows of each non-empty cell: keys and ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def extrema(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row with ``min_c`` and ``max_c`` of each column, in one pass; nulls if empty."""
    return df.agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def count_cells_dense(df: DataFrame, x: str = "frame", y: str = "scan") -> DataFrame:
    """Every cell of the grid from 0 to both maxima, with zeros; empty in, empty out."""
    top = df.agg(F.max(x).alias("_x"), F.max(y).alias("_y")).filter("_x is not null")
    # the rows are dealt before the second axis unfolds, so one task makes one axis only
    grid = top.select(F.explode(F.sequence(F.lit(0), "_x")).alias(x), "_y").repartition(x)
    grid = grid.select(F.col(x), F.explode(F.sequence(F.lit(0), "_y")).alias(y))
    return grid.join(count_cells(df, (x, y)), [x, y], "left").select(x, y, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_range(df: DataFrame, column: str, from_zero: bool) -> DataFrame:
    """Histogram ``v, n`` over 0 (or the minimum) to the maximum, zeros kept."""
    low = F.lit(0) if from_zero else F.min(column)
    ends = df.agg(low.cast("long").alias("_a"), F.max(column).cast("long").alias("_b")).filter("_b is not null")
    axis = ends.select(F.explode(F.sequence("_a", "_b")).alias("v"))
    return axis.join(histogram(df, F.col(column).cast("long")), "v", "left").select("v", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """Distinct values and their counts: ``v, n``."""
    return df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def count_unique(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n"))


def unique_per_group(df: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """Keys, ``n`` rows and ``n_unique`` values; one row per (key, value) crosses the shuffle."""
    by_value = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return by_value.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(column).alias("n_unique"))


def changes_per_group(df: DataFrame, key: str, column: str) -> DataFrame:
    """``n_distinct`` values of a group, and ``n_changes`` between them when sorted."""
    got = df.select(key, column).distinct().groupBy(key).agg(F.count(column).alias("n_distinct"))
    return got.withColumn("n_changes", F.col("n_distinct") - 1)


def add_counts(*cells: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Sum of count grids of any extents; a cell that one lacks counts as zero."""
    both = cells[0].select(*keys, "n")
    for other in cells[1:]:
        both = both.unionByName(other.select(*keys, "n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def per_group(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.groupBy(key).agg(value.cast("long").alias("value"))


def count_of_counts(df: DataFrame, inner: tuple[str, ...] = CELL, outer: str = "tof") -> DataFrame:
    """How many values of ``outer`` occur in how many ``inner`` cells."""
    cells = df.select(*inner, outer).distinct().groupBy(outer).agg(F.count(F.lit(1)).alias("cells_per_tof"))
    return cells.groupBy("cells_per_tof").agg(F.count(F.lit(1)).alias("n"))


def running(groups: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``groups``, one row a key, with the exclusive running sum ``name`` of ``value`` in key order.

    Integer keys are summed in blocks of 2^BLOCK_BITS values first, so that only
    the blocks' totals meet in one task. Other keys meet there themselves. Nulls come first.
    """
    value_of, by = F.col(value), Window.orderBy(key)
    if not isinstance(groups.schema[key].dataType, IntegralType):
        return groups.withColumn(name, F.sum(value).over(by) - value_of)
    blocked = groups.withColumn("_block", F.shiftright(F.col(key).cast("long"), BLOCK_BITS))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_whole"))
    before = totals.select(F.col("_block").alias("_of"), (F.sum("_whole").over(Window.orderBy("_block")) - F.col("_whole")).alias("_begin"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(key)) - value_of
    joined = blocked.withColumn("_inside", inside).join(before, F.col("_block").eqNullSafe(F.col("_of")))
    return joined.withColumn(name, F.col("_begin") + F.col("_inside")).drop("_block", "_of", "_begin", "_inside")


def with_starts(cells: DataFrame, first: str = "frame", rest: tuple[str, ...] = ("scan",)) -> DataFrame:
    """Exclusive prefix sum ``start`` of ``n`` in (first, rest) order.

    Totals by ``first`` are summed on their own small table, then a window runs
    inside each value; no window spans all rows.
    """
    totals = cells.groupBy(first).agg(F.sum("n").alias("_total"))
    before = running(totals, first, "_total", "_before").drop("_total")
    inside = F.sum("n").over(Window.partitionBy(first).orderBy(*rest)) - F.col("n") if rest else F.lit(0)
    return cells.join(before, first).withColumn("start", F.col("_before") + inside).drop("_before")


def cell_index(df: DataFrame) -> DataFrame:
    """``frame, scan, n, start`` of each cell."""
    return with_starts(count_cells(df))


def cell_cumsum(df: DataFrame) -> DataFrame:
    """Inclusive prefix sum ``end`` of each cell."""
    return cell_index(df).select("frame", "scan", (F.col("start") + F.col("n")).alias("end"))


def group_offsets(df: DataFrame, key: str = "frame") -> DataFrame:
    """``i, start``: group offsets in key order, with a leading 0; empty in, one row (0, 0) out."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1).cast("long"))
    ends = running(running(groups, key, "_n", "_start"), key, "_one", "_i")
    ends = ends.select((F.col("_i") + 1).alias("i"), (F.col("_start") + F.col("_n")).alias("start"))
    return df.sparkSession.createDataFrame([(0, 0)], "i long, start long").unionByName(ends)


def run_boundaries(df: DataFrame, first: str = "frame", second: str = "tof") -> DataFrame:
    """Starts of the (first, second) runs in sorted order; ``is_group_start`` marks a new ``first``."""
    runs = with_starts(count_cells(df, (first, second)), first, (second,))
    new = F.row_number().over(Window.partitionBy(first).orderBy(second)) == 1
    return runs.select(first, "start", second, new.alias("is_group_start"))


def melt_counts(grid: DataFrame) -> DataFrame:
    """The non-zero cells of a grid."""
    return grid.filter("n > 0")


def melt_array(df: DataFrame, column: str) -> DataFrame:
    """Coordinates ``i, j`` and ``value`` of the non-zeros of a column of nested arrays."""
    rows = df.select(F.posexplode(column).alias("i", "_row"))
    return rows.select("i", F.posexplode("_row").alias("j", "value")).filter("value <> 0")


def repeat_rows(cells: DataFrame, count: str = "n") -> DataFrame:
    """Each row ``count`` times, numbered ``k`` from 1; counts of zero give none."""
    return cells.filter(F.col(count) > 0).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).drop(count)


def dense_labels(df: DataFrame, column: str, label: str) -> DataFrame:
    """``column, label``: distinct values numbered from 0 in order."""
    values = df.select(column).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running(values, column, "_one", "_before").select(column, F.col("_before").cast("int").alias(label))
