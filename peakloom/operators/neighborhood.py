"""Neighbourhood statistics along scans, inside groups of equal (frame, tof).

Rows must be unique by (frame, tof, scan), that is, deduplicated. ``symmetric``
windows are the scans within the radius; ``strict`` ones also end before the
row ``radius`` positions on, which matters only where scans have no gap, and
then takes away just the row at that distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

GROUP = ("frame", "tof")


def _check(radius: int) -> None:
    if radius < 1:
        raise ValueError("the radius must be at least 1")


def _order() -> WindowSpec:
    return Window.partitionBy(*GROUP).orderBy("scan")


def _capped(radius: int) -> Column:
    return F.coalesce(F.lead("scan", radius).over(_order()) == F.col("scan") + radius, F.lit(False))


def event_count(radius: int, strict: bool = False) -> Column:
    """Rows in the window, the row itself included."""
    _check(radius)
    n = F.count(F.lit(1)).over(_order().rangeBetween(-radius, radius))
    return n - _capped(radius).cast("long") if strict else n


def tic(radius: int, strict: bool = False) -> Column:
    """Total intensity in the window."""
    _check(radius)
    total = F.sum("intensity").over(_order().rangeBetween(-radius, radius))
    return total - F.when(_capped(radius), F.lead("intensity", radius).over(_order())).otherwise(0) if strict else total


def max_others(radius: int, strict: bool = False, value: str = "intensity") -> Column:
    """Greatest value in the window without the row itself; null if it is alone."""
    _check(radius)
    left = F.max(value).over(_order().rangeBetween(-radius, -1))
    right = F.max(value).over(_order().rangeBetween(1, radius))
    if strict:
        near = F.max(value).over(_order().rangeBetween(1, radius - 1)) if radius > 1 else F.lit(None)
        right = F.when(_capped(radius), near).otherwise(right)
    return F.greatest(left, right)


def span() -> Column:
    """Rows in the whole group."""
    return F.count(F.lit(1)).over(Window.partitionBy(*GROUP))


def with_runs(df: DataFrame, radius: int, fraction: float, strict: bool = False) -> DataFrame:
    """``df`` with run borders: how far neighbours stay above ``fraction`` of the row's intensity.

    ``run_start`` (inclusive), ``run_end`` (exclusive) and ``legacy_left`` (the
    failing position itself, or the window's start) are positions in the group.
    Where the row isn't above its own threshold all three are its position.
    """
    _check(radius)
    limit = F.lit(float(fraction)) * F.col("intensity")
    order = _order()
    rows = df.withColumns(
        {
            "_at": (F.row_number().over(order) - 1).cast("long"),
            "_left": F.collect_list("intensity").over(order.rangeBetween(-radius, -1)),
            "_right": F.collect_list("intensity").over(order.rangeBetween(1, radius)),
            "_cap": _capped(radius) if strict else F.lit(False),
        }
    )
    rows = rows.withColumn("_right", F.when(F.col("_cap"), F.slice("_right", F.lit(1), F.size("_right") - 1)).otherwise(F.col("_right")))

    def run(values: Column) -> Column:
        fails = F.array_position(F.transform(values, lambda v: v <= limit), True)
        return F.when(fails > 0, fails - 1).otherwise(F.size(values)).cast("long")

    above = limit < F.col("intensity")
    before, after = run(F.reverse("_left")), run(F.col("_right"))
    all_before = before == F.size("_left")
    return rows.withColumns(
        {
            "run_start": F.when(above, F.col("_at") - before).otherwise(F.col("_at")),
            "run_end": F.when(above, F.col("_at") + after + 1).otherwise(F.col("_at")),
            "legacy_left": F.when(above, F.col("_at") - before - F.when(all_before, 0).otherwise(1)).otherwise(F.col("_at")),
        }
    ).drop("_at", "_left", "_right", "_cap")


def stats(df: DataFrame, radius: int, fraction: float, strict: bool = False) -> DataFrame:
    """The whole bundle; all windows share one shuffle and one sort.

    ``is_local_max`` is true where no other row in the window is greater;
    ``ties_max_of_others`` where the greatest other one is equal.
    """
    rows = with_runs(df, radius, fraction, strict).withColumns(
        {"span": span(), "event_count": event_count(radius, strict), "tic": tic(radius, strict), "max_others": max_others(radius, strict)}
    )
    return rows.withColumns(
        {
            "is_local_max": F.coalesce(F.col("max_others") <= F.col("intensity"), F.lit(True)),
            "ties_max_of_others": F.coalesce(F.col("max_others") == F.col("intensity"), F.lit(False)),
        }
    )


def in_box(df: DataFrame, first: int, last: int, radius: int, strict: bool = False) -> DataFrame:
    """Window count and sum for scans in [first, last], reading only a halo of ``radius`` around.

    A filter on scan can't pass below the window by itself; widened by the
    radius it can be applied first without changing either value.
    """
    near = df.filter(F.col("scan").between(first - radius, last + radius))
    got = near.withColumns({"event_count": event_count(radius, strict), "tic": tic(radius, strict)})
    return got.filter(F.col("scan").between(first, last))
