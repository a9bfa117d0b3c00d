"""Best-fit packing of token sequences by hierarchical residual packing.

Every document becomes pieces of at most ``length`` tokens. Pieces that fill a
sequence stand alone. The others are packed by best-fit decreasing inside each
partition; nearly full bins are emitted, and underfull bins become the items of
the next round, in fewer partitions, until one partition holds all that is left,
or the partitions can't be fewer and a round saves no bins. Of two bins
that fit together one is half full or less, and a partition leaves at most one
such, so all of them meet in one partition. A round's task holds at most ITEMS_PER_TASK items on
average, whatever the size of the input; that one also a bin of each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, gathered, small_batches, union
from .tokens import encoder, with_end

SEQUENCE = 1024
#: A bin with fewer free tokens than this part of a sequence is emitted.
NEARLY_FULL = 64
ITEMS_PER_TASK = 50_000
FAN_IN = 8
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BINS = "size int, members array<long>, sizes array<int>"


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32``: each document's ids cut into pieces.

    The ids are the text's, then ``end_id``, so null or empty text has one id.
    A longer document's first piece takes the remainder; the others are full.
    """
    small_batches(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_batch
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in gathered(batches, "text"):
            ids, bounds = with_end(*encode(batch.column("text").chunk(0)), end_id)
            raw = memoryview(ids.tobytes())
            rows: list[tuple] = []
            for doc, low, high in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                n, at, k = high - low, 0, 0
                while at < n:
                    to = at + ((n - at) % length or length)
                    rows.append((doc, k, at, to - at, zlib.crc32(raw[4 * (low + at) : 4 * (low + to)])))
                    at, k = to, k + 1
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, _PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of item positions, each as full as can be found greedily.

    Open bins are kept by free space in one bit mask, so an item costs O(1).
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        if room > size:
            free[room - size].append(at)
            mask |= 1 << (room - size)
    return bins


def _pack_round(items: DataFrame, capacity: int, seed: int, parts: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        got = got.sort_by("first")
        size, members, sizes = (got.column(c).to_pylist() for c in ("size", "members", "sizes"))
        bins = best_fit(size, capacity)
        for i in range(0, len(bins), 4096):
            block = bins[i : i + 4096]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sum(size[k] for k in b) for b in block], pa.int32()),
                    pa.array([[m for k in b for m in members[k]] for b in block], pa.list_(pa.int64())),
                    pa.array([[m for k in b for m in sizes[k]] for b in block], pa.list_(pa.int32())),
                ],
                names=["size", "members", "sizes"],
            )

    part = F.pmod(F.xxhash64(F.lit(seed), "first"), F.lit(parts))
    if seed:  # bins of the round before
        part = F.when(2 * F.col("size") <= capacity, F.lit(0).cast("long")).otherwise(part)
    dealt = items.withColumn("first", F.col("members")[0]).withColumn("_part", part)
    return dealt.repartition(parts, "_part").select("size", "members", "sizes", "first").mapInArrow(pack, _BINS)


def pack(cut_pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``: its place, gapless from 0.

    Every piece keeps its row, repeated rows too. No piece gives no rows.
    """
    rows = cut(cut_pieces.withColumn("_row", F.monotonically_increasing_id()))
    full = rows.filter(F.col("length") == length).select("*", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = rows.filter(F.col("length") < length).select(
        F.col("length").cast("int").alias("size"), F.array("_row").alias("members"), F.array(F.col("length").cast("int")).alias("sizes")
    )
    count, done, turn = items.count(), [], 0
    parts = max(1, -(-count // ITEMS_PER_TASK))
    while count:
        bins = cut(_pack_round(items, length, turn, parts))
        left = bins.filter(F.col("size") < length - length // NEARLY_FULL)
        now = left.count()
        fewer = max(-(-parts // FAN_IN), -(-now // ITEMS_PER_TASK))
        last = parts == 1 or (now == count and fewer == parts)
        done.append(bins if last else bins.filter(F.col("size") >= length - length // NEARLY_FULL))
        if last:
            break
        items, count, turn, parts = left, now, turn + 1, fewer
    if not done:
        return full.drop("_row")
    placed = (
        union(done)
        .select(F.col("members")[0].alias("sequence_id"), F.posexplode(F.arrays_zip("members", "sizes")).alias("_k", "_m"), "sizes")
        .select(
            "sequence_id", F.col("_m.members").alias("_row"),
            F.aggregate(F.slice("sizes", F.lit(1), F.col("_k")), F.lit(0).cast("long"), lambda a, x: a + x).alias("offset"),
        )
    )
    packed = rows.filter(F.col("length") < length).join(placed, "_row")
    return full.unionByName(packed).drop("_row")
