"""A user's function on every group of rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def group_map(df: DataFrame, keys: tuple[str, ...], function: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row per group: the keys and what ``function`` returns for its rows.

    ``schema`` names keys and results. A Python worker sees one group at a time;
    for values that Spark can express, a window or an aggregate is faster.
    """

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame([{k: first[k] for k in keys} | function(rows)])

    return df.groupBy(*keys).applyInPandas(apply, schema)
