"""Registry of the peak-event queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import min_int_type, normal_cdf
from ..operators import grid, merge, neighborhood, order, slices
from ..operators.dedup import deduplicate
from ..operators.group_map import group_map
from ..sources import files
from ..sources.lineitem import read_clusters, read_peaks

Query = Callable[[SparkSession, str], DataFrame]

RADIUS, FRACTION = 5, 0.5
PEAK = ("frame", "scan", "tof", "intensity")
BOX = {"frame": (10, 40), "scan": (20, 60), "tof": (5, 25)}
HALO = (30, 60)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# fixed text: the derived view in SQL
_VIEW = """
    WITH clusters AS (
        SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 23940 AS INTEGER) AS frame,
               CAST(l_suppkey AS INTEGER) AS scan,
               CAST(l_partkey % 40 AS INTEGER) AS tof,
               CAST(l_quantity AS BIGINT) AS intensity,
               CAST(l_orderkey AS BIGINT) AS cluster_id,
               CAST(l_linenumber AS INTEGER) AS line,
               CAST(CASE WHEN (year(l_shipdate) * 12 + month(l_shipdate) - 23940) % 4 = 1 THEN 1 ELSE 2 END AS INTEGER) AS ms_level
        FROM lineitem
    ),
    peaks AS (
        SELECT frame, scan, tof, CAST(sum(intensity) AS BIGINT) AS intensity
        FROM clusters GROUP BY frame, scan, tof
    )
"""
_FULL = "frame, scan, tof, cluster_id, intensity, line"


def _add(name: str, sql: str | None, query: Query, ctes: str = "") -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = f"{_VIEW}{', ' + ctes if ctes else ''}\n{sql}"


def _unique(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated peaks, dealt by the windows' partition key."""
    return deduplicate(read_peaks(spark, sf), co_locate=neighborhood.GROUP)


# --- sources, constructors, predicates -------------------------------------------------

_add("deduplicate", "SELECT * FROM peaks", lambda s, d: deduplicate(read_peaks(s, d)))
_add(
    "dataset_from_df",
    "SELECT tof, scan, count(*) AS n FROM clusters GROUP BY tof, scan",
    lambda s, d: grid.count_cells(read_peaks(s, d), ("tof", "scan")),
)
_add(
    "level_filter",
    "SELECT frame, scan, tof, intensity FROM clusters WHERE ms_level = 1",
    lambda s, d: slices.level(read_clusters(s, d), "precursor").select(*PEAK),
)


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_peaks(read_peaks(spark, sf), path)
    return deduplicate(files.read_peaks(spark, path))


_add("roundtrip_parquet", "SELECT * FROM peaks", _roundtrip)
_add(
    "cell_slice",
    "SELECT tof, intensity FROM clusters WHERE frame = 1 AND scan >= 3 AND scan < 7",
    lambda s, d: slices.cell_slice(read_peaks(s, d), 1, 3, 7).select("tof", "intensity"),
)
_add(
    "box_extract",
    "SELECT frame, scan, tof, intensity FROM clusters WHERE frame BETWEEN 10 AND 40 AND scan BETWEEN 20 AND 60 AND tof BETWEEN 5 AND 25",
    lambda s, d: slices.box(read_peaks(s, d), **BOX),
)

# --- counts and sums -------------------------------------------------------------------

_add("count_cells", "SELECT frame, scan, count(*) AS n FROM clusters GROUP BY frame, scan", lambda s, d: grid.count_cells(read_peaks(s, d)))
_add(
    "count_cells_dense",
    """SELECT CAST(f AS INTEGER) AS frame, CAST(s AS INTEGER) AS scan, count(c.tof) AS n
       FROM range(0, (SELECT max(frame) + 1 FROM clusters)) a(f) CROSS JOIN range(0, (SELECT max(scan) + 1 FROM clusters)) b(s)
       LEFT JOIN clusters c ON c.frame = f AND c.scan = s GROUP BY f, s""",
    lambda s, d: grid.count_cells_dense(read_peaks(s, d)),
)
_add(
    "count1d_dense",
    "SELECT v, count(c.tof) AS n FROM range(0, (SELECT max(tof) + 1 FROM clusters)) a(v) LEFT JOIN clusters c ON c.tof = v GROUP BY v",
    lambda s, d: grid.count_range(read_peaks(s, d), "tof", from_zero=True),
)
_add(
    "count1d_range",
    """SELECT v, count(c.tof) AS n FROM range((SELECT min(scan) FROM clusters), (SELECT max(scan) + 1 FROM clusters)) a(v)
       LEFT JOIN clusters c ON c.scan = v GROUP BY v""",
    lambda s, d: grid.count_range(read_peaks(s, d), "scan", from_zero=False),
)
_add("discrete_hist", "SELECT intensity AS v, count(*) AS n FROM clusters GROUP BY intensity", lambda s, d: grid.histogram(read_peaks(s, d), F.col("intensity")))
_add(
    "minmax",
    "SELECT min(frame) AS min_frame, max(frame) AS max_frame, min(scan) AS min_scan, max(scan) AS max_scan FROM clusters",
    lambda s, d: grid.extrema(read_peaks(s, d), ("frame", "scan")),
)
_add("count_unique", "SELECT count(DISTINCT tof) AS n FROM clusters", lambda s, d: grid.count_unique(read_peaks(s, d), "tof"))
_add(
    "unique_tof_per_cell",
    "SELECT frame, scan, count(*) AS n, count(DISTINCT tof) AS n_unique FROM clusters GROUP BY frame, scan",
    lambda s, d: grid.unique_per_group(read_peaks(s, d), grid.CELL, "tof"),
)
_add(
    "tof_changes_per_frame",
    "SELECT frame, count(DISTINCT tof) AS n_distinct, count(DISTINCT tof) - 1 AS n_changes FROM clusters GROUP BY frame",
    lambda s, d: grid.changes_per_group(read_peaks(s, d), "frame", "tof"),
)
_add(
    "add_cell_counts",
    """SELECT frame, scan, CAST(sum(n) AS BIGINT) AS n FROM (
           SELECT frame, scan, count(*) AS n FROM clusters WHERE scan < 50 GROUP BY ALL
           UNION ALL SELECT frame, scan, count(*) AS n FROM clusters WHERE frame < 40 GROUP BY ALL) GROUP BY frame, scan""",
    lambda s, d: grid.add_counts(
        grid.count_cells(read_peaks(s, d).filter("scan < 50")), grid.count_cells(read_peaks(s, d).filter("frame < 40"))
    ),
)
_add(
    "tic_per_frame",
    "SELECT frame, CAST(sum(intensity) AS BIGINT) AS value FROM clusters GROUP BY frame",
    lambda s, d: grid.per_group(read_peaks(s, d), "frame", F.sum("intensity")),
)
_add(
    "peaks_per_frame",
    "SELECT frame, count(*) AS value FROM clusters GROUP BY frame",
    lambda s, d: grid.per_group(read_peaks(s, d), "frame", F.count(F.lit(1))),
)
_add(
    "tof_count_of_counts",
    "SELECT cells_per_tof, count(*) AS n FROM (SELECT tof, count(DISTINCT (frame, scan)) AS cells_per_tof FROM clusters GROUP BY tof) GROUP BY cells_per_tof",
    lambda s, d: grid.count_of_counts(read_peaks(s, d)),
)

# --- prefix sums -----------------------------------------------------------------------

_CELLS = "cells AS (SELECT frame, scan, count(*) AS n FROM clusters GROUP BY frame, scan)"
_add(
    "cell_index",
    "SELECT frame, scan, n, CAST(sum(n) OVER (ORDER BY frame, scan) - n AS BIGINT) AS start FROM cells",
    lambda s, d: grid.cell_index(read_peaks(s, d)),
    _CELLS,
)
_add(
    "cell_cumsum",
    'SELECT frame, scan, CAST(sum(n) OVER (ORDER BY frame, scan) AS BIGINT) AS "end" FROM cells',
    lambda s, d: grid.cell_cumsum(read_peaks(s, d)),
    _CELLS,
)
_add(
    "group_offsets",
    """SELECT 0::BIGINT AS i, 0::BIGINT AS start UNION ALL
       SELECT row_number() OVER (ORDER BY frame) AS i, CAST(sum(n) OVER (ORDER BY frame) AS BIGINT) AS start
       FROM (SELECT frame, count(*) AS n FROM clusters GROUP BY frame)""",
    lambda s, d: grid.group_offsets(read_peaks(s, d)),
)
_add(
    "run_boundaries",
    """SELECT frame, CAST(sum(n) OVER (ORDER BY frame, tof) - n AS BIGINT) AS start, tof,
              row_number() OVER (PARTITION BY frame ORDER BY tof) = 1 AS is_group_start
       FROM (SELECT frame, tof, count(*) AS n FROM clusters GROUP BY frame, tof)""",
    lambda s, d: grid.run_boundaries(read_peaks(s, d)),
)

# --- order -----------------------------------------------------------------------------


def _ordered(keys: tuple[str, ...], *columns: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return order.with_positions(read_clusters(spark, sf), keys, order.FULL).select("pos", *columns)

    return query


def _order_sql(keys: str, columns: str) -> str:
    by = ", ".join(dict.fromkeys(f"{keys}, {_FULL}".split(", ")))
    return f"SELECT row_number() OVER (ORDER BY {by}) - 1 AS pos, {columns} FROM clusters"


for _name, _keys, _columns in (
    ("lex_sort_clusters", order.FULL, (*PEAK, "cluster_id")),
    ("lex_order_1d", ("tof",), ("tof",)),
    ("lex_order_2d", ("frame", "scan"), ("frame", "scan")),
    ("lex_order_3d", ("frame", "scan", "tof"), ("frame", "scan", "tof")),
    ("sort_frame_tof_scan", ("frame", "tof", "scan"), ("frame", "tof", "scan", "intensity")),
    ("sort_tof_scan_frame", ("tof", "scan", "frame"), ("frame", "tof", "scan", "intensity")),
):
    _add(_name, _order_sql(", ".join(_keys), ", ".join(_columns)), _ordered(_keys, *_columns))

_add(
    "grouped_rank",
    f"SELECT frame, tof, row_number() OVER (PARTITION BY frame ORDER BY tof, {_FULL}) - 1 AS rank FROM clusters",
    lambda s, d: order.grouped_rank(read_clusters(s, d), "frame", ("tof",), order.FULL).select("frame", "tof", "rank"),
)
_add(
    "grouped_lex_rank",
    f"SELECT frame, tof, scan, row_number() OVER (PARTITION BY frame ORDER BY tof, scan, {_FULL}) - 1 AS rank FROM clusters",
    lambda s, d: order.grouped_rank(read_clusters(s, d), "frame", ("tof", "scan"), order.FULL).select("frame", "tof", "scan", "rank"),
)
_add(
    "pack_keys",
    """SELECT frame, scan, tof,
              (frame::BIGINT * (SELECT max(scan) + 1 FROM clusters) + scan) * (SELECT max(tof) + 1 FROM clusters) + tof AS packed
       FROM clusters""",
    lambda s, d: order.pack_keys(read_peaks(s, d).select("frame", "scan", "tof"), ("frame", "scan", "tof")),
)
_add(
    "rank_of_rows",
    f"SELECT {_FULL}, row_number() OVER (ORDER BY {_FULL}) - 1 AS rank FROM clusters",
    lambda s, d: order.with_positions(read_clusters(s, d), order.FULL, name="rank").select(*order.FULL, "rank"),
)


def _checks(keys: tuple[str, ...], strict: bool = False) -> Query:
    """The check on rows stored in order, on the deduplicated rows, and on rows stored by cluster."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = read_clusters(spark, sf)
        cases = {
            "sorted": order.with_positions(rows, order.FULL),
            "unique": order.with_positions(deduplicate(rows), ("frame", "scan", "tof")),
            "unsorted": order.with_positions(rows, ("cluster_id", "line"), order.FULL),
        }
        return merge.merge(*[order.out_of_order(df, keys, strict).withColumn("case", F.lit(name)) for name, df in cases.items()])

    return query


def _checks_sql(keys: str, strict: bool = False) -> str:
    key = f"({keys})" if "," in keys else keys
    bad = ">=" if strict else ">"
    cases = {"sorted": (_FULL, "clusters"), "unique": ("frame, scan, tof", "peaks"), "unsorted": (f"cluster_id, line, {_FULL}", "clusters")}
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "case", count(*) = 0 AS ok FROM (
                SELECT {key} AS k, lag({key}) OVER (ORDER BY {by}) AS p FROM {source}) WHERE p {bad} k"""
        for name, (by, source) in cases.items()
    )


_add("is_sorted_1d", _checks_sql("frame"), _checks(("frame",)))
_add("is_lex_sorted", _checks_sql("frame, scan, tof"), _checks(("frame", "scan", "tof")))
_add("is_lex_strict", _checks_sql("frame, scan, tof", True), _checks(("frame", "scan", "tof"), True))


def _is_permutation(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_clusters(spark, sf)
    good = order.is_permutation(order.with_positions(rows, order.FULL), "pos").withColumn("case", F.lit("positions"))
    return good.unionByName(order.is_permutation(rows, "tof").withColumn("case", F.lit("tof")))


_add(
    "is_permutation",
    """SELECT 'positions' AS "case", true AS ok UNION ALL
       SELECT 'tof', count(*) = count(DISTINCT tof) AND min(tof) = 0 AND max(tof) = count(*) - 1 FROM clusters""",
    _is_permutation,
)


def _is_arange(spark: SparkSession, sf: str) -> DataFrame:
    rows = order.with_positions(read_clusters(spark, sf), order.FULL)
    good = order.is_arange(rows, "pos", "pos").withColumn("case", F.lit("positions"))
    return good.unionByName(order.is_arange(rows, "pos", "tof").withColumn("case", F.lit("tof")))


_add(
    "is_arange",
    """SELECT 'positions' AS "case", true AS ok, NULL::BIGINT AS at, NULL::BIGINT AS found UNION ALL
       SELECT 'tof', count(*) = 0, min(pos), CAST(arg_min(tof, pos) AS BIGINT) FROM ordered WHERE tof <> pos""",
    _is_arange,
    f"ordered AS (SELECT tof, row_number() OVER (ORDER BY {_FULL}) - 1 AS pos FROM clusters)",
)

# --- reshape and combine ---------------------------------------------------------------

_add("melt_counts", "SELECT * FROM cells", lambda s, d: grid.melt_counts(grid.count_cells_dense(read_peaks(s, d))), _CELLS)
_add("melt_index_long", "SELECT * FROM cells", lambda s, d: grid.count_cells(read_peaks(s, d)), _CELLS)
_REPEATED = "SELECT frame, scan, unnest(range(1, n + 1)) AS k FROM cells"
_add("melt_index_very_long", _REPEATED, lambda s, d: grid.repeat_rows(grid.cell_index(read_peaks(s, d)).drop("start")), _CELLS)
_add("decount", _REPEATED, lambda s, d: grid.repeat_rows(grid.count_cells(read_peaks(s, d))), _CELLS)
_add(
    "frame_to_drt",
    "SELECT frame, CAST(row_number() OVER (ORDER BY frame) - 1 AS INTEGER) AS drt FROM (SELECT DISTINCT frame FROM clusters WHERE ms_level = 1)",
    lambda s, d: grid.dense_labels(slices.level(read_clusters(s, d)), "frame", "drt"),
)


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_clusters(spark, sf)
    return merge.merge(*[slices.level(rows, w).select(*PEAK) for w in ("precursor", "fragment")])


_add("merge_datasets", "SELECT frame, scan, tof, intensity FROM clusters", _levels)
_add("merge_dedup", "SELECT * FROM peaks", lambda s, d: deduplicate(_levels(s, d)))
_add("dataset_equal", "SELECT true AS equal", lambda s, d: merge.equal(_levels(s, d), read_peaks(s, d)))

# --- neighbourhoods --------------------------------------------------------------------

_NEAR = f"""
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY frame, tof ORDER BY scan) - 1 AS place,
               count(*) OVER (PARTITION BY frame, tof) AS span
        FROM peaks
    ),
    joined AS (
        SELECT a.frame, a.scan, a.tof, a.intensity, a.place, a.span, b.place AS b_at, b.intensity AS b_int,
               b.place >= a.place + {RADIUS} AS beyond
        FROM placed a JOIN placed b ON a.frame = b.frame AND a.tof = b.tof AND b.scan BETWEEN a.scan - {RADIUS} AND a.scan + {RADIUS}
    ),
    near AS (
        SELECT frame, scan, tof, intensity, place, span,
               count(*) AS event_count,
               count(*) FILTER (WHERE NOT beyond) AS event_count_strict,
               CAST(sum(b_int) AS BIGINT) AS tic,
               CAST(sum(b_int) FILTER (WHERE NOT beyond) AS BIGINT) AS tic_strict,
               max(b_int) FILTER (WHERE b_at <> place) AS max_others,
               max(b_int) FILTER (WHERE b_at <> place AND NOT beyond) AS max_others_strict,
               max(b_at) FILTER (WHERE b_at < place AND b_int <= {FRACTION} * intensity) AS fail_left,
               min(b_at) FILTER (WHERE b_at > place AND b_int <= {FRACTION} * intensity) AS fail_right,
               min(b_at) AS first_at, max(b_at) AS last_at
        FROM joined GROUP BY frame, scan, tof, intensity, place, span
    ),
    full_stats AS (
        SELECT *, coalesce(fail_left + 1, first_at) AS run_start, coalesce(fail_right, last_at + 1) AS run_end,
               coalesce(fail_left, first_at) AS legacy_left,
               coalesce(max_others <= intensity, true) AS is_local_max,
               coalesce(max_others = intensity, false) AS ties_max_of_others
        FROM near
    )
"""


def _windowed(value: Callable[[int, bool], object]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _unique(spark, sf).select("frame", "scan", "tof", value(RADIUS, False).alias("value"), value(RADIUS, True).alias("value_strict"))

    return query


for _name, _value, _column in (
    ("window_event_count", neighborhood.event_count, "event_count"),
    ("window_tic", neighborhood.tic, "tic"),
    ("window_max_others", neighborhood.max_others, "max_others"),
):
    _add(_name, f"SELECT frame, scan, tof, {_column} AS value, {_column}_strict AS value_strict FROM near", _windowed(_value), _NEAR)

_add(
    "group_span",
    "SELECT frame, tof, scan, span FROM placed",
    lambda s, d: _unique(s, d).select("frame", "tof", "scan", neighborhood.span().alias("span")),
    _NEAR,
)
_add(
    "threshold_run",
    "SELECT frame, scan, tof, run_start, run_end, legacy_left FROM full_stats",
    lambda s, d: neighborhood.with_runs(_unique(s, d), RADIUS, FRACTION).select("frame", "scan", "tof", "run_start", "run_end", "legacy_left"),
    _NEAR,
)
_STATS = ("frame", "scan", "tof", "intensity", "span", "event_count", "tic", "max_others", "run_start", "run_end", "legacy_left", "is_local_max", "ties_max_of_others")


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return neighborhood.stats(_unique(spark, sf), RADIUS, FRACTION)


_add("neighborhood_stats", f"SELECT {', '.join(_STATS)} FROM full_stats", lambda s, d: _stats(s, d).select(*_STATS), _NEAR)
_add(
    "box_neighborhood_halo",
    f"SELECT frame, scan, tof, event_count, tic FROM near WHERE scan BETWEEN {HALO[0]} AND {HALO[1]}",
    lambda s, d: neighborhood.in_box(_unique(s, d), *HALO, RADIUS).select("frame", "scan", "tof", "event_count", "tic"),
    _NEAR,
)
for _column, _value in (("event_count", neighborhood.event_count), ("tic", neighborhood.tic)):
    _add(
        f"hist_{_column}",
        f"SELECT {_column} AS v, count(*) AS n FROM near GROUP BY v",
        lambda s, d, value=_value: grid.histogram(_unique(s, d).select(value(RADIUS).alias("x")), F.col("x")),
        _NEAR,
    )
_add(
    "hist_run_length",
    "SELECT run_end - run_start AS v, count(*) AS n FROM full_stats GROUP BY v",
    lambda s, d: grid.histogram(neighborhood.with_runs(_unique(s, d), RADIUS, FRACTION), F.col("run_end") - F.col("run_start")),
    _NEAR,
)
_add(
    "count_maxima",
    "SELECT count(*) AS n FROM full_stats WHERE is_local_max",
    lambda s, d: _unique(s, d)
    .select("intensity", neighborhood.max_others(RADIUS).alias("m"))
    .filter("m is null or m <= intensity")
    .agg(F.count(F.lit(1)).alias("n")),
    _NEAR,
)

# --- user functions, scalars -----------------------------------------------------------

_add(
    "group_map",
    "SELECT frame, tof, count(*) AS n, CAST(sum(intensity) AS BIGINT) AS total FROM peaks GROUP BY frame, tof",
    lambda s, d: group_map(
        _unique(s, d), neighborhood.GROUP, lambda g: {"n": len(g), "total": int(g["intensity"].sum())}, "frame int, tof int, n long, total long"
    ),
)
_add(
    "min_int_type",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column",
                CAST(CASE WHEN max({c}) <= 127 THEN 8 WHEN max({c}) <= 32767 THEN 16 WHEN max({c}) <= 2147483647 THEN 32 ELSE 64 END AS INTEGER) AS bits_signed,
                CAST(CASE WHEN max({c}) <= 255 THEN 8 WHEN max({c}) <= 65535 THEN 16 WHEN max({c}) <= 4294967295 THEN 32 ELSE 64 END AS INTEGER) AS bits_unsigned
            FROM clusters"""
        for c in (*PEAK, "cluster_id")
    ),
    lambda s, d: min_int_type(read_clusters(s, d), (*PEAK, "cluster_id")),
)
_add(
    "normal_cdf",
    None,
    lambda s, d: s.range(-400, 401).select((F.col("id") / 100.0).alias("x")).withColumn("cdf", F.round(normal_cdf(F.col("x")), 9)),
)
# no erf in SQL: the density times the sum of x^(2k+1) / (1 * 3 * … * (2k+1))
ORACLE["normal_cdf"] = """
    WITH RECURSIVE sums(x, k, term, total) AS (
        SELECT i / 100.0::DOUBLE, 0, i / 100.0::DOUBLE, i / 100.0::DOUBLE FROM range(-400, 401) t(i)
        UNION ALL
        SELECT x, k + 1, term * x * x / (2 * k + 3), total + term * x * x / (2 * k + 3) FROM sums WHERE k < 60
    )
    SELECT CAST(x AS DOUBLE) AS x, round(0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * total, 9) AS cdf FROM sums WHERE k = 60
"""
