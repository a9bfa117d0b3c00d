"""Exact dedup: two Bloom passes pick the possibly repeated hashes, which alone shuffle.

Pass 1 counts the rows on every cell of a one-hash Bloom filter, combined on the
map side; cells hit twice set a bit. (One number crosses the shuffle for a row.
Bitmaps made in each task would be smaller for few tasks only: tasks times filter,
which grows with the square of the input.) Rows on a set bit go through pass 2,
the same over another hash and the far fewer survivors. Rows that either pass
clears are certainly unique and pass straight through; the others are grouped by
SHA-256. The filter is a table of 4 KiB bitmaps keyed by bucket, so it can be
broadcast where its size, known before it is built, allows, and joined by bucket
beyond that. All this is done on slim rows of id and hash, never on texts.
Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fresh_name, skew_join, text_of

#: Bits in one bitmap of ``bitmap_construct_agg``.
BUCKET_BITS = 32768
BITS_PER_ROW = 16
MAX_BROADCAST_BYTES = 32 << 20
#: Rows of a checked broadcast of the rows to drop, about 100 bytes each.
BROADCAST_ROWS = 300_000


def _cell(sha: str, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(sha)), F.lit(bits))


def filter_bits(rows: int) -> int:
    """Size of the filter in bits: a power of two, BITS_PER_ROW for each row."""
    return max(BUCKET_BITS, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length())


def repeat_filter(slim: DataFrame, seed: int, bits: int, sha: str = "_sha") -> DataFrame:
    """Bitmaps, by bucket, of the cells that two or more rows of ``slim`` hit."""
    cells = slim.groupBy(_cell(sha, seed, bits).alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return cells.groupBy(F.bitmap_bucket_number("_cell").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_cell")).alias("_bitmap")
    )


def split_by_filter(rows: DataFrame, bitmaps: DataFrame, seed: int, bits: int, sha: str = "_sha") -> DataFrame:
    """``rows`` plus a boolean ``_maybe``: whether the row's bit is set."""
    cell = _cell(sha, seed, bits)
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    keyed = rows.withColumn("_bucket", F.bitmap_bucket_number(cell)).withColumn("_at", at)
    side = F.broadcast(bitmaps) if bits // 8 <= MAX_BROADCAST_BYTES else bitmaps
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
    return (
        keyed.join(side, "_bucket", "left")
        .withColumn("_maybe", F.coalesce(bit, F.lit(False)))
        .drop("_bucket", "_at", "_bitmap")
    )


def _sha(text: str) -> Column:
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def _filters(slim: DataFrame) -> list[tuple[DataFrame, int, int]]:
    """The filters of both passes over the hashes in ``slim``."""
    bits = filter_bits(slim.count())
    first = cut(repeat_filter(slim, 1, bits))
    left = cut(split_by_filter(slim, first, 1, bits).filter("_maybe").select("_sha"))
    bits2 = filter_bits(left.count())
    return [(first, 1, bits), (cut(repeat_filter(left, 2, bits2)), 2, bits2)]


def _marked(rows: DataFrame, filters: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """``rows`` with ``_maybe`` set where both filters have the row's bit."""
    (f1, s1, b1), (f2, s2, b2) = filters
    rows = split_by_filter(rows, f1, s1, b1).withColumnRenamed("_maybe", "_first")
    return split_by_filter(rows, f2, s2, b2).withColumn("_maybe", F.col("_first") & F.col("_maybe")).drop("_first")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _sha, _row) that are certainly unique, and the others with their group's _keep and _size."""
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    slim = cut(slim.select("_id", _sha("_text").alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    marked = _marked(slim, _filters(slim))
    maybe = cut(marked.filter("_maybe").select("_id", "_sha", "_row"))
    groups = cut(
        maybe.groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    return marked.filter(~F.col("_maybe")), skew_join(maybe, groups, "_sha", "_size", maybe.count())


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: which of its equal texts stays.

    Columns: the id, keep_id, group_size, kept and text_sha256. Null text counts
    as empty; no normalisation. The largest id stays; a null id is below all
    others, and rows that share both id and text keep one of them. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    unique, others = _grouped(docs, id_col, text_col)
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    grouped = others.select(
        F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"), sha,
    )
    alone = unique.select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha,
    )
    return alone.unionByName(grouped)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that :func:`duplicate_report` keeps, with all their columns, whatever their names.

    The ids and hashes of the rows that go are broadcast to the documents, which
    are not shuffled; if they are more than BROADCAST_ROWS, both sides are
    shuffled once, by hash and id, which spreads even one huge group of copies.
    Of rows that share the kept id and the text, which alone are compared as
    whole rows, one stays.
    """
    same = F.col("_id").eqNullSafe(F.col("_keep._id"))
    _, others = _grouped(docs, id_col, text_col)
    gone = cut(others.filter(F.col("_row") != F.col("_keep._row")).select("_sha", "_id", same.alias("_same")).distinct())
    count, twins = gone.agg(F.count(F.lit(1)), F.count(F.when(F.col("_same"), 1))).first()
    sha = fresh_name(docs, "_sha")
    that, id_, same = fresh_name(docs, "_that"), fresh_name(docs, "_id"), fresh_name(docs, "_same")
    marks = gone.toDF(that, id_, same)
    marks = F.broadcast(marks) if count <= BROADCAST_ROWS else marks
    met = (F.col(sha) == F.col(that)) & F.col(f"`{id_col}`").eqNullSafe(F.col(id_))
    marked = docs.withColumn(sha, _sha(f"`{text_col}`")).join(marks, met, "left")
    quoted = [f"`{c}`" for c in docs.columns]
    out = marked.filter(F.col(same).isNull()).select(quoted)
    if twins:
        out = out.unionByName(marked.filter(F.col(same)).dropDuplicates([sha, id_col]).select(quoted))
    return out
