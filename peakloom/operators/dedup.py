"""Merging of repeated (frame, scan, tof) coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ("frame", "scan", "tof")


def deduplicate(peaks: DataFrame, co_locate: tuple[str, ...] = (), multiplicity: bool = False) -> DataFrame:
    """One row per coordinate with the summed intensity.

    Rows combine before the shuffle. ``co_locate`` names columns of the key to
    partition by instead, which serves a later window over them with the same
    shuffle, at the price of the combining. ``multiplicity`` adds the number of
    merged events. An empty input gives an empty result.
    """
    rows = peaks.repartition(*co_locate) if co_locate else peaks
    sums = [F.sum("intensity").alias("intensity")]
    if multiplicity:
        sums.append(F.count(F.lit(1)).alias("multiplicity"))
    return rows.groupBy(*KEY).agg(*sums)
