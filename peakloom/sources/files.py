"""Parquet storage of datasets, and exchange with NumPy archives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.grid import cell_index

#: Frames in one folder of a stored dataset.
FRAMES_PER_FOLDER = 64


def write_peaks(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Store a dataset by frame range, sorted by frame, tof and scan inside.

    Folders prune by frame; row groups of sorted files prune by frame and tof.
    """
    bucketed = df.withColumn("frame_bucket", F.floor(F.col("frame") / FRAMES_PER_FOLDER).cast("int"))
    dealt = bucketed.repartitionByRange("frame_bucket", "frame", "tof").sortWithinPartitions("frame_bucket", "frame", "tof", "scan")
    dealt.write.mode("overwrite").option("compression", compression).partitionBy("frame_bucket").parquet(path)


def read_peaks(spark: SparkSession, path: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """A stored dataset, or its frames in an inclusive range, reading their folders only."""
    df = spark.read.parquet(path)
    if frames is not None:
        low, high = (f // FRAMES_PER_FOLDER for f in frames)
        df = df.filter(F.col("frame_bucket").between(low, high) & F.col("frame").between(*frames))
    return df.drop("frame_bucket")


def read_indexed(spark: SparkSession, path: str, frames: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """A stored dataset and its index of cells (frame, scan, n, start), counted anew."""
    rows = read_peaks(spark, path, frames)
    return rows, cell_index(rows)


def write_npz(df: DataFrame, path: str, max_rows: int = 10_000_000, compress: bool = True) -> None:
    """Export columns to one archive on the driver; larger datasets raise ValueError."""
    import numpy as np

    if df.count() > max_rows:
        raise ValueError(f"more than {max_rows} rows; store Parquet instead")
    pdf = df.toPandas()
    (np.savez_compressed if compress else np.savez)(path, **{c: pdf[c].to_numpy() for c in pdf.columns})


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """The columns of an archive as a DataFrame."""
    import numpy as np
    import pandas as pd

    with np.load(path) as z:
        return spark.createDataFrame(pd.DataFrame({k: z[k] for k in z.files}))


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="peakloom-")
    return f"{base}/{uuid.uuid4().hex}"
