"""Peak events derived from the ``lineitem`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, scan, tof, intensity, cluster_id, line, ms_level`` from lineitem."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 23940
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        month.cast("int").alias("frame"),
        F.col("l_suppkey").cast("int").alias("scan"),
        (F.col("l_partkey") % 40).cast("int").alias("tof"),
        F.col("l_quantity").cast("long").alias("intensity"),
        F.col("l_orderkey").cast("long").alias("cluster_id"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.when(month % 4 == 1, 1).otherwise(2).cast("int").alias("ms_level"),
    )


def read_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, scan, tof, intensity`` of every event."""
    return read_clusters(spark, sf_dir).select("frame", "scan", "tof", "intensity")
