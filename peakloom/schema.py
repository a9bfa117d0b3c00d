"""Canonical schemas and checks at the API's edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

_COORDINATES = [StructField(c, IntegerType()) for c in ("frame", "scan", "tof")]
PEAKS = StructType([*_COORDINATES, StructField("intensity", LongType())])
CLUSTERS = StructType([*PEAKS.fields, StructField("cluster_id", LongType())])
CELLS = StructType([*_COORDINATES[:2], StructField("n", LongType()), StructField("start", LongType())])
FRAMES = StructType([StructField("frame", IntegerType()), StructField("ms_level", IntegerType()), StructField("num_peaks", LongType())])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or ValueError naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def from_columns(spark: SparkSession, columns: dict | object, schema: StructType | None = None) -> DataFrame:
    """A DataFrame from a dict of equally long columns, or from a pandas DataFrame."""
    import pandas as pd

    if isinstance(columns, dict):
        lengths = {len(v) for v in columns.values()}
        if len(lengths) > 1:
            raise ValueError(f"columns of different lengths: {sorted(lengths)}")
        columns = pd.DataFrame(columns)
    if schema is None:
        return spark.createDataFrame(columns)
    satellites = [StructField(c, LongType()) for c in columns.columns if c not in schema.names]
    return spark.createDataFrame(columns[[*schema.names, *[f.name for f in satellites]]], StructType([*schema.fields, *satellites]))
