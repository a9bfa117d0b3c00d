"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on ids.

Documents are dealt by id range, tokenised and written sorted, so a file and its
stripes hold consecutive documents: stripes read in parallel, and stripe, row
index and Bloom filter statistics let a reader of a few documents skip the rest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, gathered, partitions, shared_dir, small_batches
from .tokens import encoder, in_lists, with_end

END_ID = 2
#: Bytes of a stripe before compression, and rows between entries of its index.
STRIPE, STRIDE = 16 << 20, 1000
ORC = {
    "orc.compress": "ZLIB",
    "orc.stripe.size": str(STRIPE),
    "orc.row.index.stride": str(STRIDE),
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write ``doc_id, n_tokens, ids`` as ORC under ``path`` in ascending doc_id order.

    Null text counts as empty and has the end id alone; null ids come first;
    rows that repeat an id are ordered by text. Other columns are not written.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_batch
        for batch in gathered(batches, "text"):
            ids, bounds = with_end(*encode(batch.column("text").chunk(0)), end_id)
            docs = batch.column("doc_id").chunk(0)
            for own, lists in in_lists(ids, bounds):
                counts = pa.array(np.diff(bounds[own.start : own.stop + 1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([docs[own], counts, lists], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(2 * partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>").write.options(**ORC).mode("overwrite").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents under ``path``: ``doc_id, n_tokens, ids``; filters reach the files."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read back from the files.

    ``start`` is a two-level running sum: files, a few rows, then rows in a file.
    """
    small_batches(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, pa.array(crc, pa.int64()), batch.column("file"), batch.column("at")],
                names=["doc_id", "n_tokens", "ids_crc32", "file", "at"],
            )

    found = read_tokens(spark, path).select(
        "doc_id", "ids", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    found = found.withColumn("at", F.struct("block", F.monotonically_increasing_id().alias("row"))).drop("block")
    rows = found.select("doc_id", "ids", "file", "at").mapInArrow(
        digest, "doc_id long, n_tokens long, ids_crc32 long, file int, at struct<block: long, row: long>"
    )
    rows = cut(rows)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = files.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    in_file = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at")) - F.col("n_tokens")
    return rows.withColumn("_in", in_file).join(F.broadcast(before), "file").select(
        "doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
