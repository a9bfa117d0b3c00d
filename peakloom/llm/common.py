"""Shared pieces of the text operators: checkpoints, skew-safe joins, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Groups above total / HOT_SHARE rows count as hot, so at most HOT_SHARE are.
HOT_SHARE = 1000
#: Distinct edges that one task may join; beyond it components are found in rounds.
LOCAL_EDGES = 1_000_000
#: Rows in one Arrow batch: bounds a Python worker's memory for long texts.
ARROW_ROWS = 512
#: Bytes of text that a task takes at once where a dictionary serves many texts.
BATCH_CHARS = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="peakloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files, in whatever store it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, a tenth of the cost of hashing them."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, as texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The batches as tables of about BATCH_CHARS bytes of ``column``, so that a dictionary serves many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= BATCH_CHARS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def text_of(col: str) -> Column:
    """The text, or the empty string for null."""
    return F.coalesce(F.col(col), F.lit(""))


def fresh_name(df: DataFrame, name: str = "_own") -> str:
    """``name``, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key in ``groups``.

    Keys whose ``size`` passes total / HOT_SHARE, fewer than HOT_SHARE by
    arithmetic, are broadcast; the others are shuffled, where no key holds more
    than that share.
    """
    limit = total / HOT_SHARE
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold.hint("shuffle_merge"), key))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """For each node the smallest of its neighbours and itself."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")).withColumn("m", F.least("a", "m"))


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    return skew_join(edges, _least(edges), "a", "size", total)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task."""
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not got:
        return
    a, b = (np.concatenate(c) for c in zip(*got))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in range(len(up)):
        up[x] = up[up[x]]  # parents come first and are already at their root
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[up], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components: a row ``(node, component)`` for every node of an edge.

    ``edges`` has long columns a and b; the component is its smallest node.
    Self-loops and repeated edges are allowed; no edges give no rows. Up to
    LOCAL_EDGES distinct edges are joined by one task. More go through
    alternating large-star and small-star steps, each checkpointed, where hub
    nodes are joined by :func:`skew_join`.
    """
    edges = cut(edges.select("a", "b").distinct())
    if edges.count() <= LOCAL_EDGES:
        return cut(edges.coalesce(1).mapInArrow(_joined, "node long, component long"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        count, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count or seen == (count, mark):
            break
        seen = (count, mark)
        large = (
            _with_least(_both_ways(now), 2 * count)
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        large = cut(large)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _with_least(down, count)
        now = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
    labels = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
