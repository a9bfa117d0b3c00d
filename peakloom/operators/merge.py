"""Union and comparison of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge(*parts: DataFrame, source: str | None = None) -> DataFrame:
    """Bag union by column name; ``source`` adds a column with each part's number.

    Different column sets raise ValueError.
    """
    wanted = set(parts[0].columns)
    for p in parts[1:]:
        if set(p.columns) != wanted:
            raise ValueError(f"different columns: {sorted(wanted ^ set(p.columns))}")
    if source:
        parts = tuple(p.withColumn(source, F.lit(i)) for i, p in enumerate(parts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def equal(one: DataFrame, other: DataFrame, position: str | None = None) -> DataFrame:
    """One row ``equal``: whether both hold the same rows equally often.

    Signed counts of each row must vanish, one shuffle for both sides. With a
    ``position`` column in both, the order counts too. NaN equals NaN.
    """
    if set(one.columns) != set(other.columns):
        return one.sparkSession.createDataFrame([(False,)], "equal boolean")
    if position is not None and position not in one.columns:
        raise ValueError(f"no column {position}")
    columns = sorted(one.columns)
    signed = one.select(*columns, F.lit(1).alias("_sign")).unionByName(other.select(*columns, F.lit(-1).alias("_sign")))
    left = signed.groupBy(*columns).agg(F.sum("_sign").alias("_left")).filter("_left <> 0")
    return left.agg((F.count(F.lit(1)) == 0).alias("equal"))
