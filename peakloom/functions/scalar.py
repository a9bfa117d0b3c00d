"""Scalar functions and type reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


#: Terms of the series and levels of the fraction: both are exact to a double's last bits where they are used.
_TERMS, _LEVELS, _SERIES_TO = 50, 100, 2.0


def normal_cdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """P(X <= x) of a normal distribution, within 1e-14, as a JVM expression; null for null.

    Up to 2 standard deviations times the root of 2, erf comes from its series of
    positive terms, beyond from the continued fraction of erfc, which keeps tails
    exact relative to their size.
    """
    z = (x.cast("double") - F.lit(float(mu))) / F.lit(sigma * math.sqrt(2.0))

    def of(z: Column) -> Column:
        y, square = F.abs(z), z * z
        series = F.lit(1.0)
        for k in range(_TERMS, 0, -1):
            series = F.lit(1.0) + series * square * F.lit(2.0 / (2 * k + 1))
        half_erf = z * F.exp(-square) * series * F.lit(1.0 / math.sqrt(math.pi))
        fraction = y
        for k in range(_LEVELS, 0, -1):
            fraction = y + F.lit(k / 2.0) / fraction
        half_erfc = F.exp(-square) / fraction * F.lit(0.5 / math.sqrt(math.pi))
        return F.when(y < _SERIES_TO, F.lit(0.5) + half_erf).when(z < 0, half_erfc).otherwise(F.lit(1.0) - half_erfc)

    # a one-element transform binds z, which occurs in every term
    return F.transform(F.array(z), of)[0]


def bits_for(top: Column, signed: bool) -> Column:
    """The smallest of 8, 16, 32 and 64 bits that hold a non-negative maximum."""
    case = F.lit(64)
    for bits in (32, 16, 8):
        case = F.when(top <= (1 << (bits - signed)) - 1, bits).otherwise(case)
    return case


def min_int_type(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``column, bits_signed, bits_unsigned`` by the columns' maxima, in one pass."""
    tops = df.agg(*[F.max(c).cast("long").alias(c) for c in columns])
    long = tops.unpivot([], list(columns), "column", "_top")
    return long.select("column", bits_for(F.col("_top"), True).alias("bits_signed"), bits_for(F.col("_top"), False).alias("bits_unsigned"))
