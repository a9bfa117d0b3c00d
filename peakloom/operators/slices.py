"""Projection and box predicates that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def level(df: DataFrame, which: str = "precursor") -> DataFrame:
    """Rows of MS1 (``precursor``), MS2 (``fragment``) or ``both``."""
    if which == "both":
        return df
    wanted = {"precursor": 1, "fragment": 2}[which]
    return df.filter(F.col("ms_level") == wanted)


def level_by_frames(df: DataFrame, frames: DataFrame, which: str = "precursor") -> DataFrame:
    """The same where the level is in a frames table instead of the rows."""
    return df.join(level(frames, which).select("frame"), "frame", "left_semi")


def cell_slice(df: DataFrame, frame: int, first: int, end: int) -> DataFrame:
    """Rows of one frame with scans in [first, end)."""
    return df.filter((F.col("frame") == frame) & (F.col("scan") >= first) & (F.col("scan") < end))


def box(df: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Rows inside inclusive bounds by column name."""
    for column, (low, high) in bounds.items():
        df = df.filter(F.col(column).between(low, high))
    return df
