"""Line dedup with a log-template tree.

A line walks a tree of fixed depth: its token count, then its leading tokens,
where tokens with digits are fields. Lines of one leaf that agree in most
positions share a template, whose differing positions are fields too. A template
in enough documents is boilerplate, and its lines are dropped from all of them;
the longer its lines, the fewer documents are enough. Copies of one text count
once towards fewer than MIN_DOCUMENTS, or two copies would lose their passages.

Leaves in too few documents can't hold such a template, so only the lines of the
others, as hashes, go on. A leaf of too many different lines is dealt to blocks
whose templates are merged again, until no two of the leaf's can be: first in
fewer blocks each round, and where templates stay too many for one block, with
every block meeting every other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from xxhash import xxh3_64_intdigest

from .common import components, cut, fresh_name, partitions, skew_join, small_batches, text_of, union

DEPTH = 3
#: Share of positions that lines of one template agree in.
SIMILARITY = 0.7
MIN_DOCUMENTS = 8
#: A line of so many tokens recurs in LONG_DOCUMENTS; between, the number falls evenly.
LONG_TOKENS, LONG_DOCUMENTS = 50, 2
#: Lines of fewer tokens are no passages and recur by chance: they need SHORT_FACTOR times the documents.
MIN_TOKENS, SHORT_FACTOR = 4, 2
#: Different lines in a leaf, beyond which it is dealt to blocks.
LEAF_LINES = 1024
CHUNK = 500_000
#: Rows of a checked broadcast of leaves; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Hashes of recurring lines, 8 bytes each, that are sent to all tasks.
BROADCAST_LINES = 2_000_000

FIELD = "<*>"
_DIGIT = re.compile(r"\d")
_KEEP = (1 << 63) - 1


def _hash(data: bytes) -> int:
    return xxh3_64_intdigest(data) & _KEEP


def masked(line: str) -> list[str]:
    """The line's tokens, those with digits as fields; a short line of nothing else keeps them."""
    tokens = line.split()
    if not _DIGIT.search(line):
        return tokens
    fields = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens if len(tokens) < MIN_TOKENS and all(t is FIELD for t in fields) else fields


def _joined(tokens: list[str]) -> bytes:
    return "\0".join(tokens).encode("utf-8", "surrogatepass")


def leaf(tokens: list[str]) -> int:
    """The hash of the tree's path: token count and leading tokens."""
    return _hash(b"%d\0" % len(tokens) + _joined(tokens[:DEPTH]))


def needed(tokens: int, documents: int) -> int:
    """Documents in which a line of so many tokens is boilerplate, where a line of MIN_TOKENS is so in ``documents``."""
    if tokens < MIN_TOKENS:
        return SHORT_FACTOR * documents
    fall = (documents - min(documents, LONG_DOCUMENTS)) * (min(tokens, LONG_TOKENS) - MIN_TOKENS)
    return documents - fall // (LONG_TOKENS - MIN_TOKENS)


def lines_of(text: str) -> Iterator[tuple[int, list[str]]]:
    """Number and masked tokens of the lines that have any."""
    for i, line in enumerate(text.split("\n")):
        tokens = masked(line)
        if tokens:
            yield i, tokens


def leaf_counts(docs: DataFrame, documents: int) -> DataFrame:
    """Documents by leaf, added up in each task first, and the number needed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        needs: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            columns = (list(counts), list(counts.values()), [needs[at] for at in counts])
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["leaf", "n", "need"])
            counts.clear()
            needs.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for at, size in {leaf(t): len(t) for _, t in lines_of(text)}.items():
                    if at not in counts:
                        needs[at] = needed(size, documents)
                    counts[at] = counts.get(at, 0) + 1
            if len(counts) > CHUNK:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(work, "leaf long, n long, need long").groupBy("leaf").agg(F.sum("n").alias("n"), F.max("need").alias("need"))


def _line_rows(docs: DataFrame) -> DataFrame:
    """A row per line that isn't blank: row, copy, no, leaf, line (hash), tokens (masked)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                copy = _hash(text.encode("utf-8", "surrogatepass"))
                for no, t in lines_of(text):
                    whole = _joined(t)
                    out.append((row, copy, no, leaf(t), _hash(whole), whole))
            row, copy, no, at, line, tokens = zip(*out) if out else ((),) * 6
            longs = [pa.array(c, pa.int64()) for c in (row, copy, no, at, line)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(tokens, pa.binary())], names=["row", "copy", "no", "leaf", "line", "tokens"])

    return docs.mapInArrow(work, "row long, copy long, no long, leaf long, line long, tokens binary")


def grow(lines: list[tuple[int, np.ndarray]]) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """Line to template (its first line), and the templates' tokens, for the lines of one leaf.

    Lines are taken in order of their hash, and so are templates until no two of
    them can be merged. Lines may be templates; a field agrees with any token.
    """
    items = sorted(lines, key=lambda x: x[0])
    up = {line: line for line, _ in items}
    while len(items) > 1:
        names, kept = [], np.empty((len(items), len(items[0][1])), np.int64)
        for line, tokens in items:
            old = kept[: len(names)]
            equal, fixed = old == tokens, (old != 0) & (tokens != 0)
            share = np.mean(equal | ~fixed, axis=1)
            share[np.mean(equal & fixed, axis=1) < SIMILARITY - 0.2] = 0
            best = int(np.argmax(share)) if names else 0
            if names and share[best] >= SIMILARITY:
                kept[best][kept[best] != tokens] = 0
                up[line] = names[best]
            else:
                kept[len(names)] = tokens
                names.append(line)
        merged = len(names) < len(items)
        items = list(zip(names, kept))
        if not merged:
            break
    for line in sorted(up):  # templates come before their lines
        up[line] = up[up[line]]
    return up, dict(items)


def _grown(items: DataFrame, raw: bool) -> DataFrame:
    """``leaf, block, blocks, line, template, tokens`` for items (leaf, group, block, blocks, line, tokens).

    The items of one group of a leaf meet. Tokens are hashes (bytes of lines if
    ``raw``); of the result, only templates of leaves of many blocks have them.
    """

    def work(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list] = {}
        field = FIELD.encode()
        for at, group, block, blocks, line, tokens in zip(*(table.column(c).to_pylist() for c in ("leaf", "group", "block", "blocks", "line", "tokens"))):
            hashes = np.array([_hash(t) if t != field else 0 for t in tokens.split(b"\0")], np.int64) if raw else np.frombuffer(tokens, np.int64)
            groups.setdefault((at, group), []).append((line, hashes, block, blocks))
        out = []
        for (at, _), group in groups.items():
            up, kept = grow([x[:2] for x in group])
            out += [(at, block, blocks, line, up[line], kept[line].tobytes() if blocks > 1 and line in kept else None) for line, _, block, blocks in group]
        at, block, blocks, line, template, tokens = zip(*out)
        longs = [pa.array(c, pa.int64()) for c in (at, block, blocks, line, template)]
        return pa.Table.from_arrays([*longs, pa.array(tokens, pa.binary())], names=["leaf", "block", "blocks", "line", "template", "tokens"])

    spark = items.sparkSession
    bins = max(partitions(spark), items.count() // LEAF_LINES)
    binned = items.withColumn("_bin", F.pmod(F.xxhash64("leaf", "group"), F.lit(bins)))
    return cut(binned.groupBy("_bin").applyInArrow(work, "leaf long, block long, blocks long, line long, template long, tokens binary"))


def _blocked(items: DataFrame, seed: int, limit: int) -> DataFrame:
    """``leaf, line, tokens`` of ``items`` with ``block`` and ``blocks``: about ``limit`` lines to each."""
    sizes = items.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    sized = skew_join(items.select("leaf", "line", "tokens"), sizes, "leaf", "size", max(1, items.count()))
    sized = sized.withColumn("blocks", F.when(F.col("size") <= LEAF_LINES, 1).otherwise(F.ceil(F.col("size") / limit)).cast("long")).drop("size")
    return sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "line"), F.col("blocks")))


def _facing(turn: int) -> Column:
    """The group of a block in this turn of a round robin: each turn pairs all blocks, and blocks - 1 turns all pairs."""
    others = F.col("blocks") - 1
    last = F.pmod(F.lit(turn) * (F.col("blocks") / 2).cast("long"), others)
    return F.when(F.col("block") == others, last).otherwise(F.least("block", F.pmod(F.lit(turn) - F.col("block"), others)))


def templates(lines: DataFrame) -> DataFrame:
    """``line, template`` for distinct lines (leaf, line, tokens)."""
    first = _grown(_blocked(lines, 0, LEAF_LINES).withColumn("group", F.col("block")), True)
    large = first.filter("blocks > 1")
    if large.isEmpty():
        return first.select("line", "template")
    moves, turn = [], 0

    def met(items: DataFrame) -> DataFrame:
        """The templates left of ``items`` when those of each group have met."""
        now = _grown(items, False)
        moves.append(now.filter("line <> template").select(F.col("line").alias("a"), F.col("template").alias("b")))
        return now.filter("line = template").drop("template")

    moves.append(large.filter("line <> template").select(F.col("line").alias("a"), F.col("template").alias("b")))
    left, before = large.filter("line = template").drop("template"), large.count()
    while (count := left.count()) and count <= 0.7 * before:
        turn, before = turn + 1, count
        left = met(_blocked(left, turn, LEAF_LINES).withColumn("group", F.col("block"))).filter("blocks > 1")
    before = None
    while (count := left.count()) and count != before:
        turn, before = turn + 1, count
        left = _blocked(left, turn, max(1, LEAF_LINES // 2))
        left = cut(left.withColumn("blocks", F.when(F.col("blocks") > 1, F.col("blocks") + F.col("blocks") % 2).otherwise(F.lit(1)).cast("long")))
        # a leaf that fits into one block is finished there
        single = left.filter("blocks = 1").withColumn("group", F.lit(0).cast("long"))
        if not single.isEmpty():
            met(single)
        left = left.filter("blocks > 1")
        for k in range((left.agg(F.max("blocks")).first()[0] or 1) - 1):
            rest = left.filter(F.col("blocks") <= k + 1)
            left = met(left.filter(F.col("blocks") > k + 1).withColumn("group", _facing(k))).unionByName(rest.select("leaf", "block", "blocks", "line", "tokens"))
    joined = components(union(moves))
    found = large.select("line").join(joined, F.col("line") == F.col("node"), "left").select("line", F.coalesce("component", "line").alias("template"))
    return first.filter("blocks = 1").select("line", "template").unionByName(found)


def _row_key(docs: DataFrame, id_col: str, text_col: str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text_of(f"`{text_col}`"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``line``: the hashes of the different lines, masked, that are boilerplate."""
    small_batches(docs.sparkSession)
    rows = docs.select(_row_key(docs, id_col, text_col).alias("row"), text_of(f"`{text_col}`").alias("text"))
    leaves = cut(leaf_counts(rows, min_documents).filter("n >= need"))
    side = leaves.select("leaf", "need")
    side = F.broadcast(side) if leaves.count() <= BROADCAST_ROWS else side
    lines = cut(_line_rows(rows).join(side, "leaf"))
    distinct = lines.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"), F.first("need").alias("need"), F.count(F.lit(1)).alias("size"))
    distinct = cut(distinct)
    named = cut(templates(distinct.select("leaf", "line", "tokens")).join(distinct.select("line", "size", "need"), "line"))
    placed = skew_join(lines.select("row", "copy", "line"), named, "line", "size", max(1, lines.count())).select("row", "copy", "template", "need")
    spread = placed.distinct().groupBy("template", "copy").agg(F.count(F.lit(1)).alias("docs"), F.first("need").alias("need"))
    spread = spread.groupBy("template").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("texts"), F.first("need").alias("need"))
    common = spread.filter((F.col("docs") >= F.greatest("need", F.lit(min_documents))) | (F.col("texts") >= F.col("need")))
    sizes = named.groupBy("template").agg(F.count(F.lit(1)).alias("variants"))
    common = cut(common.select("template").join(sizes, "template"))
    return cut(skew_join(named.select("line", "template"), common, "template", "variants", max(1, named.count())).select("line"))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` without their recurring lines, and the columns ``n_lines`` and ``n_dropped``.

    Null text counts as empty and becomes empty; rows that repeat id and text are
    one document; an empty table gives no rows; where the caller has columns of
    the added names, the added ones get an underscore more.

    The hashes of up to BROADCAST_LINES recurring lines are sent to all tasks, so
    that documents aren't shuffled. Beyond that, lines meet them by hash, and a
    document the numbers of its recurring lines by two hashes of its id and text.
    """
    spark = docs.sparkSession
    names, drop = docs.columns, recurring_lines(docs, id_col, text_col, min_documents)
    n_lines, n_dropped = fresh_name(docs, "n_lines"), fresh_name(docs, "n_dropped")
    schema = StructType([*(f if f.name != text_col else StructField(text_col, StringType()) for f in docs.schema), StructField(n_lines, LongType()), StructField(n_dropped, LongType())])

    def without(texts: list[str | None], gone_of: Callable[[list[list[tuple[int, int]]]], list[set[int]]]) -> list[pa.Array]:
        parts = [(t or "").split("\n") for t in texts]
        gone = gone_of([[(no, _hash(_joined(tokens))) for no, tokens in lines_of(t or "")] for t in texts])
        kept = ["\n".join([x for i, x in enumerate(p) if i not in g]) if g else t or "" for t, p, g in zip(texts, parts, gone)]
        return [pa.array(kept, pa.string()), pa.array(map(len, parts), pa.int64()), pa.array(map(len, gone), pa.int64())]

    if (count := drop.count()) <= BROADCAST_LINES:
        held = spark.sparkContext.broadcast(np.sort(drop.toArrow().column(0).to_numpy()) if count else np.empty(0, np.int64))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def gone_of(lines: list[list[tuple[int, int]]]) -> list[set[int]]:
                hashes = np.array([h for own in lines for _, h in own], np.int64)
                at = np.minimum(np.searchsorted(held.value, hashes), max(0, count - 1))
                hit = iter((held.value[at] == hashes).tolist() if count else [False] * len(hashes))
                return [{no for (no, _), y in zip(own, hit) if y} for own in map(list, lines)]

            for batch in batches:
                text, *extra = without(batch.column(text_col).to_pylist(), gone_of)
                columns = [text if c == text_col else batch.column(i) for i, c in enumerate(batch.schema.names)]
                yield pa.RecordBatch.from_arrays([*columns, *extra], names=schema.names)

        return docs.mapInArrow(work, schema)
    row, also, gone = fresh_name(docs, "_row"), fresh_name(docs, "_also"), fresh_name(docs, "_drop")
    keyed = docs.withColumn(row, _row_key(docs, id_col, text_col)).withColumn(also, _row_key(docs, id_col, text_col, 1))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r, s, no, _hash(_joined(t))) for r, s, text in zip(*(c.to_pylist() for c in batch.columns)) for no, t in lines_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)], names=["row", "also", "no", "line"])

    lines = cut(keyed.select(row, also, text_of(f"`{text_col}`")).mapInArrow(numbered, "row long, also long, no long, line long"))
    sizes = lines.join(drop, "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("size"))
    met = skew_join(lines, cut(sizes), "line", "size", max(1, lines.count()))
    drops = met.groupBy(F.col("row").alias(row), F.col("also").alias(also)).agg(F.collect_set("no").alias(gone))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [set(x or ()) for x in batch.column(gone).to_pylist()]
            text, *extra = without(batch.column(text_col).to_pylist(), lambda _: numbers)
            columns = [text if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=schema.names)

    return keyed.join(drops, [row, also], "left").mapInArrow(apply, schema)
