"""Document fingerprints: every shingle hash below a fixed share of the hash range.

Sketches of documents of any length are comparable and merge by union. A text
with few hashes below the threshold keeps its FLOOR smallest instead, and its
own threshold with them; two sketches are compared below the smaller of their
thresholds, where both are whole. A short text may have too few hashes there to
say how much of it a long one contains: then containment is unknown, null, not 0.
Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, text_of

WIDTH = 5
#: One hash in SHARE is kept, and at least the FLOOR smallest.
SHARE, FLOOR = 8, 16
#: Hashes of the smaller sketch below the common threshold, from which containment is estimated.
LEAST = 3
#: Ranges of ids at most; each is a task's, so a run of more data needs more.
RANGES = 32_768
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_SPACE = r"[ \t\n\x0B\f\r]+"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the word shingles, in order, repeats included.

    Words are runs without white space, in lower case; a text of fewer words is
    one shingle, and one without words has none.
    """
    words = F.array_remove(F.split(F.lower(text), _SPACE), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def over(ws: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ws) - width)
        return F.when(F.size(ws) >= width, F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))).when(
            F.size(ws) > 0, F.array(F.xxhash64(ws, F.size(ws)))
        ).otherwise(F.array().cast("array<long>"))

    # a one-element transform binds the word hashes, so that they are computed once
    return F.flatten(F.transform(F.array(hashed), over))


def sketch(text: Column, width: int = WIDTH, share: int = SHARE, floor: int = FLOOR) -> Column:
    """A struct of sorted distinct ``hashes`` and the ``threshold`` up to which they are whole."""
    limit = F.lit(_LOWEST + (1 << 64) // share).cast("long")

    def keep(hashes: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h <= limit)))

        def choose(low: Column) -> Column:
            least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, floor)
            short = F.struct(least.alias("hashes"), F.when(F.size(least) < floor, F.lit(_HIGHEST)).otherwise(F.element_at(least, -1)).alias("threshold"))
            return F.when(F.size(low) >= floor, F.struct(low.alias("hashes"), limit.alias("threshold"))).otherwise(short)

        return F.transform(F.array(low), choose)[0]

    return F.transform(F.array(shingle_hashes(text, width)), keep)[0]


def likeness(one: Column, other: Column) -> dict[str, Column]:
    """Estimates from two sketches: ``jaccard``, and ``containment`` of the one with fewer hashes in the other.

    1 where the sketches are equal, 0 where one is of no shingles; ``containment``
    is null where fewer than LEAST of its hashes can be compared and these are not all.
    """
    limit = F.least(one["threshold"], other["threshold"])
    a = F.filter(one["hashes"], lambda h: h <= limit)
    b = F.filter(other["hashes"], lambda h: h <= limit)
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    same = F.when(one["hashes"] == other["hashes"], F.lit(1.0))
    empty = (F.size(one["hashes"]) == 0) | (F.size(other["hashes"]) == 0)
    whole = limit == _HIGHEST  # neither sketch leaves any hash out
    return {
        "jaccard": same.when(n + m == 0, F.lit(0.0)).otherwise(both / (n + m - both)),
        "containment": same.when(empty, F.lit(0.0)).when((F.least(n, m) >= LEAST) | whole, both / F.least(n, m)),
    }


def merged(sketches: Column) -> Column:
    """The sketch of the union of the texts whose sketches are in an array column."""
    limit = F.array_min(F.transform(sketches, lambda s: s["threshold"]))
    hashes = F.array_sort(F.array_distinct(F.flatten(F.transform(sketches, lambda s: s["hashes"]))))
    return F.struct(F.filter(hashes, lambda h: h <= limit).alias("hashes"), limit.alias("threshold"))


def _bucket(key: Column, borders: list[int]) -> Column:
    """How many borders are below the key, found in two steps."""
    if not borders:
        return F.lit(0)
    step = max(1, int(len(borders) ** 0.5))
    every = F.lit(borders).cast("array<long>")
    coarse = F.lit(borders[::step]).cast("array<long>")
    at = F.greatest(F.size(F.filter(coarse, lambda b: b < key)) - 1, F.lit(0)) * step
    return at + F.size(F.filter(F.slice(every, at + 1, F.lit(step)), lambda b: b < key))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_key, _h, text, _bucket, _ghost``: each bucket's rows in order, then one of the next bucket's.

    Rows are dealt by range of (id, hash of the text), an id of many rows to
    several ranges, and the first row of each range is also sent to the range
    before it, the last's to the first; so no row needs a global sort.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST)).alias("_key"), text_of(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    n = min(RANGES, 2 * partitions(spark))
    found = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    hot = {k: times for k in set(found) if (times := found.count(k)) > 1}  # ids of several ranges' rows
    borders = sorted(set(found) | {k - 1 for k in hot if k > _LOWEST})
    part = F.lit(0)
    if hot:
        times = F.element_at(F.map_from_arrays(F.lit(list(hot)).cast("array<long>"), F.lit([t + 1 for t in hot.values()])), F.col("_key"))
        share = F.col("_h").cast("double") / 2.0**64 + 0.5
        part = F.coalesce(F.least(F.floor(share * times).cast("int"), times - 1), F.lit(0))
    rows = rows.withColumn("_bucket", _bucket(F.col("_key"), borders).cast("long") * (2 * RANGES) + part)
    heads = rows.groupBy("_bucket").agg(F.max(F.struct("_key", "_h")).alias("head")).collect()  # at most 2 n rows
    heads = sorted(((*r["head"], r["_bucket"]) for r in heads), reverse=True)
    rows = rows.withColumn("_ghost", F.lit(0))
    if not heads:
        return rows
    before = [(key, h, heads[i - 1][2], 1 + int(i == 0)) for i, (key, h, _) in enumerate(heads)]
    ghosts = rows.drop("_bucket", "_ghost").join(
        F.broadcast(spark.createDataFrame(before, "_key long, _h long, _bucket long, _ghost int")), ["_key", "_h"]
    )
    return rows.unionByName(ghosts.groupBy("_key", "_h", "_bucket", "_ghost").agg(F.min("text").alias("text")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text's last floor(n_chars / 2) code points come from the start of
    the next document. Null text counts as empty, whose fingerprint is empty; a
    null id is the lowest; rows of one id are ordered by a hash of their text; an empty table
    gives no rows; other columns are ignored. ``near_*`` are Jaccard estimates,
    ``contained_*`` containment, null where unknown.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("_bucket").orderBy("_ghost", F.desc("_key"), F.desc("_h"), "text")
    rows = with_next(docs, id_col, text_col).withColumn("next_text", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    made = rows.select(
        "_key", "_h", "_bucket", "_ghost", "text", F.length("text").cast("long").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("_own"), sketch(edited).alias("_edited"),
    )
    made = made.withColumn("_next", F.lead("_own").over(order)).filter("_ghost = 0")
    to_edited, to_next = likeness(F.col("_own"), F.col("_edited")), likeness(F.col("_own"), F.col("_next"))
    shown = lambda c: F.array_join(F.transform(F.col(c)["hashes"], F.hex), " ")
    return made.select(
        F.when(F.col("_key") != _LOWEST, F.col("_key")).alias("doc_id"), "n_chars", "edited_sha256",
        shown("_own").alias("fingerprint"), shown("_edited").alias("edited_fingerprint"),
        to_edited["jaccard"].alias("near_edited"), to_next["jaccard"].alias("near_next"),
        to_edited["containment"].alias("contained_edited"), to_next["containment"].alias("contained_next"),
    )
