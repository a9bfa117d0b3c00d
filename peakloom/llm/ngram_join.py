"""Similarity self-join on word n-grams (Jaccard) with prefix trees.

1. Every text becomes its set of shingle hashes; equal sets form a class. Half of
   the hash range is compared over all sets: one with more shingles that no other
   set has than a link may leave over links with nothing, and is settled.
2. The shingles of the sets left are counted exactly. The counts are the global
   order, common first: shingles of one set alone are known not to be shared, so
   they are dropped, and count as the first of its rarest.
3. Two sets that link share one of their floor(n/4) + 1 rarest shingles, at
   positions that leave enough shingles for the overlap (the remaining length
   bounds the partner's size). Connected classes are the candidate groups.
4. The sets of a candidate group, in blocks of at most BLOCK, are stored in a
   prefix tree in the global order and probed with remaining-length bounds; pairs
   already in one component are skipped. A group of many blocks joins its blocks'
   components again, block-wise, until that changes little. A set that then still
   shares a rare shingle with a set of another component probes the tree of that
   one's block, of the shingle's most frequent component only from outside.
Every pair is decided in a tree. No link between different sets is lost, no group
meets in one task, and a set goes to a block once.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_intdigest

from .common import components, cut, fresh_name, partitions, skew_join, small_batches, union
from .prefix_tree import spanning_links
from .shingles import WIDTH, shingles

PERCENT = 75
BLOCK = 128
#: Shingles in a block, beyond which a group is cut into more blocks.
BLOCK_TOKENS = 1_000_000
#: Shingles that a task holds at once, a chunk; its sets are at most CHUNK_SETS.
CHUNK, CHUNK_SETS = 2_000_000, 60_000
#: Records in one bucket of a shuffle by shingle.
BUCKET = 1_000_000
#: Classes on one shingle, beyond which they are connected in a chain instead of by pairs; the same within a chunk.
CROWDED, COMBINED = 16, 64
#: Rows of a checked broadcast of candidate ids.
BROADCAST_ROWS = 1_000_000

_KEEP = (1 << 63) - 1
#: The owner of a shingle that several sets of a chunk have.
_NOBODY = 65_535
_LOW = np.uint64(0xFFFFFFFF)
#: What is sent for a shingle: its low bits and the chunk's set that has it, or its sets' number.
_OWNED = np.dtype([("token", "<u4"), ("owner", "<u2")])
_COUNTED = np.dtype([("token", "<u4"), ("count", "<u2")])
#: What is sent for a rare shingle: who has it, the least size, the largest partner.
_RECORD = np.dtype([("token", "<u8"), ("node", "<i8"), ("least", "<u4"), ("partner", "<u4")])


def _halves(values: np.ndarray) -> tuple[int, int]:
    digest = xxh3_128_intdigest(values.tobytes())
    return (digest >> 64) & _KEEP, digest & _KEEP


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def slack(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The shingles of a set of n that a set linked with it may lack."""
    return n - -(-percent * n // 100)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the hash range that each token is in; their low halves tell those of a bucket apart."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _sampled(tokens: np.ndarray) -> np.ndarray:
    """The tokens from a fixed half of the hash range."""
    return tokens[tokens >> np.uint64(32) & np.uint64(1) == 0]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(values)])


def _dealt(records: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Records, in order of their bucket, as bytes for each bucket that has any."""
    starts, lengths = _runs(bucket)
    return bucket[starts].tolist(), [records[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]


class _Chunk:
    """Sets of a task until their shingles are enough to be sent."""

    def __init__(self):
        self.id, self.sets, self.size, self.rows, self.owners = secrets.randbits(62), [], 0, 0, {}

    def full(self) -> bool:
        return self.size >= CHUNK or self.rows >= CHUNK_SETS

    def add(self, name: int, tokens: np.ndarray) -> tuple[int, bool]:
        """The place of the set of this name, and whether it is new."""
        self.rows += 1
        at = self.owners.get(name)
        if at is not None:
            return at, False
        at = self.owners[name] = len(self.sets)
        self.sets.append(tokens)
        self.size += len(tokens)
        return at, True

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sorted tokens of all sets, the sets that have them, and the runs of equal ones."""
        tokens = np.concatenate([np.empty(0, np.uint64), *self.sets])
        owners = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        by = np.argsort(tokens, kind="stable")
        return tokens[by], owners[by], *_runs(tokens[by])


_DESCRIBED = "doc_id long, n long, hi long, lo long, chunk long, owner int, bucket int, blob binary"


def describe(docs: DataFrame, id_col: str, text_col: str, buckets: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per document (doc_id, n, hi, lo, and its set's chunk and owner there), and rows of packed shingles.

    The latter have a bucket; bucket -1 has the repeated shingles that each of the
    chunk's sets needs, besides those that repeat within the chunk.
    """

    def packed(chunk: _Chunk, sizes: list[tuple[int, int]]) -> pa.RecordBatch:
        tokens, owners, starts, lengths = chunk.tokens()
        inside = np.bincount(owners[np.repeat(lengths > 1, lengths)], minlength=len(chunk.sets))
        n, sampled = np.array(sizes, np.int64).reshape(-1, 2).T
        needs = (sampled - slack(n, percent) - inside).astype(np.int32)
        records = np.empty(len(starts), _OWNED)
        records["token"], records["owner"] = tokens[starts] & _LOW, np.where(lengths > 1, _NOBODY, owners[starts])
        present, blobs = _dealt(records, _bucket(tokens[starts], buckets))
        rows, none = len(present) + 1, lambda kind: pa.nulls(len(present) + 1, kind)
        return _batch(
            doc_id=none(pa.int64()), n=none(pa.int64()), hi=none(pa.int64()), lo=none(pa.int64()), chunk=pa.array([chunk.id] * rows, pa.int64()),
            owner=none(pa.int32()), bucket=pa.array([-1, *present], pa.int32()), blob=pa.array([needs.tobytes(), *blobs], pa.binary()),
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sizes = _Chunk(), []
        for batch in batches:
            rows, done = [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, width)
                hi, lo = _halves(own)
                at, new = chunk.add((hi, lo), _sampled(own)) if len(own) else (0, False)
                if new:
                    sizes.append((len(own), len(chunk.sets[at])))
                rows.append((len(own), hi, lo, chunk.id, at))
                if chunk.full():
                    done.append(packed(chunk, sizes))
                    chunk, sizes = _Chunk(), []
            n, hi, lo, ids, at = (pa.array(c, pa.int64()) for c in zip(*rows)) if rows else (pa.array([], pa.int64()),) * 5
            none = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())
            yield _batch(doc_id=batch.column(0), n=n, hi=hi, lo=lo, chunk=ids, owner=at.cast(pa.int32()), bucket=none[0], blob=none[1])
            yield from done
        if chunk.sets:
            yield packed(chunk, sizes)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, _DESCRIBED)


def open_sets(described: DataFrame) -> DataFrame:
    """``chunk, owner`` of the sets that may link: enough of their sampled shingles are in another set too."""

    def repeated(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        records = np.frombuffer(b"".join(blobs), _OWNED)
        chunk = np.repeat(np.arange(len(blobs)), [len(b) // _OWNED.itemsize for b in blobs])
        by = np.argsort(records["token"], kind="stable")
        _, lengths = _runs(records["token"][by])
        again = by[np.repeat(lengths > 1, lengths)]
        again = np.sort(again[records["owner"][again] != _NOBODY])
        starts, counts = _runs(chunk[again])
        owners = records["owner"][again]
        ids = table.column("chunk").take(pa.array(chunk[again][starts]))
        return pa.table({"chunk": ids, "owners": pa.array([owners[a : a + n].tobytes() for a, n in zip(starts, counts)], pa.binary())})

    def enough(table: pa.Table) -> pa.Table:
        needs = np.frombuffer(b"".join(b for b in table.column("needs").to_pylist() if b), np.int32)
        owners = np.frombuffer(b"".join(b for b in table.column("owners").to_pylist() if b), "<u2")
        left = np.flatnonzero(np.bincount(owners, minlength=len(needs)) >= needs)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(left), pa.int64()), "owner": pa.array(left, pa.int32())})

    met = described.filter("bucket >= 0").select("chunk", "bucket", "blob").groupBy("bucket").applyInArrow(repeated, "chunk long, owners binary")
    needs = described.filter("bucket = -1").select("chunk", F.col("blob").alias("needs"), F.lit(None).cast("binary").alias("owners"))
    both = needs.unionByName(met.select("chunk", F.lit(None).cast("binary").alias("needs"), "owners"))
    return both.groupBy("chunk").applyInArrow(enough, "chunk long, owner int")


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 128, then in eighths of an octave. 1 stands for one set alone."""
    large = 128 + np.minimum(127, 8 * np.log2(np.maximum(counts, 128) / 128)).astype(np.int64)
    return np.where(counts < 128, counts, large).astype(np.uint8)


def ordered_sets(docs: DataFrame, wanted: DataFrame, tokens: int, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the classes ``wanted`` (rep, hi, lo), with ``tokens`` shingles in all, those that may link.

    Gives rows (rep, n, keys), the shared shingles in the global order as sortable
    numbers, and the edges (a, b) of classes that meet at a rare shingle.
    """
    spark = docs.sparkSession
    buckets = max(partitions(spark), -(-tokens // BUCKET))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, reps = _Chunk(), []

        def packed() -> pa.RecordBatch:
            values, _, starts, lengths = chunk.tokens()
            records = np.empty(len(starts), _COUNTED)
            records["token"], records["count"] = values[starts] & _LOW, np.minimum(lengths, 65_535)
            present, blobs = _dealt(records, _bucket(values[starts], buckets))
            return _batch(
                chunk=pa.array([chunk.id] * (len(reps) + len(present)), pa.int64()), bucket=pa.array([None] * len(reps) + present, pa.int32()),
                rep=pa.array(reps + [None] * len(present), pa.int64()), blob=pa.array([s.tobytes() for s in chunk.sets] + blobs, pa.binary()),
            )

        for batch in batches:
            for rep, text, hi, lo in zip(*(batch.column(c).to_pylist() for c in ("rep", "text", "hi", "lo"))):
                own = shingles(text, width)
                if _halves(own) == (hi, lo) and chunk.add(rep, own)[1]:
                    reps.append(rep)
                if chunk.full():
                    yield packed()
                    chunk, reps = _Chunk(), []
        if chunk.sets:
            yield packed()

    def count(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        records = np.frombuffer(b"".join(blobs), _COUNTED)
        by = np.argsort(records["token"], kind="stable")
        starts, lengths = _runs(records["token"][by])
        codes = np.empty(len(records), np.uint8)
        codes[by] = np.repeat(_codes(np.add.reduceat(records["count"][by].astype(np.int64), starts)), lengths)
        cuts = np.cumsum([len(b) // _COUNTED.itemsize for b in blobs])[:-1]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array([c.tobytes() for c in np.split(codes, cuts)], pa.binary())})

    def order(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending")])
        is_set = table.column("bucket").is_null()
        sets, counts = table.filter(is_set), table.filter(pc.invert(is_set))
        codes = np.frombuffer(b"".join(counts.column("blob").to_pylist()), np.uint8)
        raw = sets.column("blob").to_pylist()
        values, place = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        keys = (np.uint64(255) - codes.astype(np.uint64)) << np.uint64(56) | values >> np.uint64(8)
        reps, sizes, kept, records = [], [], [], []
        for rep, own in zip(sets.column("rep").to_pylist(), np.split(place, np.cumsum([len(b) // 8 for b in raw])[:-1])):
            shared = np.sort(keys[own[codes[own] > 1]])
            if len(own) - len(shared) > slack(len(own), percent):
                continue
            reps.append(rep)
            sizes.append(len(own))
            kept.append(shared.tobytes())
            records.append(rare(shared, rep, len(own), percent))
        edges, found = _combined(np.concatenate([np.empty(0, _RECORD), *records]))
        bucket = (found["token"] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        present, blobs = _dealt(found[by], bucket[by])
        k = len(present) + 1
        return pa.table({
            "bucket": pa.array([None] * len(reps) + [-1, *present], pa.int32()), "rep": pa.array(reps + [None] * k, pa.int64()),
            "n": pa.array(sizes + [None] * k, pa.int64()), "blob": pa.array([*kept, edges.tobytes(), *blobs], pa.binary()),
        })

    def meet(table: pa.Table) -> pa.Table:
        found = _meeting(np.frombuffer(b"".join(table.column("blob").to_pylist()), _RECORD), CROWDED)
        return pa.table({"a": _longs(found[:, 0]), "b": _longs(found[:, 1])})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
            yield _batch(a=_longs(found[:, 0]), b=_longs(found[:, 1]))

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").alias("text"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    chunks = cut(texts.join(side, "rep").mapInArrow(work, "chunk long, bucket int, rep long, blob binary"))
    counted = chunks.filter("bucket is not null").groupBy("bucket").applyInArrow(count, "chunk long, bucket int, blob binary")
    both = chunks.filter("bucket is null").unionByName(counted.withColumn("rep", F.lit(None).cast("long")))
    ordered = cut(both.groupBy("chunk").applyInArrow(order, "bucket int, rep long, n long, blob binary"))
    met = ordered.filter("bucket >= 0").select("bucket", "blob").groupBy("bucket").applyInArrow(meet, "a long, b long")
    edges = met.union(ordered.filter("bucket = -1").select("blob").mapInArrow(unpack, "a long, b long"))
    return ordered.filter("bucket is null").select("rep", "n", F.col("blob").alias("keys")), edges


def rare(keys: np.ndarray, node: int, n: int, percent: int = PERCENT) -> np.ndarray:
    """Records of the shared shingles, ``keys`` in the global order, at which a set of n meets every set that it links with.

    The shingles of this set alone come first among its rarest, so only the rest
    of slack + 1 are sent. At a position, the overlap is at most n - position, and
    percent * (n + m) / (100 + percent) at least, which bounds the partner's size m.
    """
    alone, last = n - len(keys), slack(n, percent)
    position = np.arange(alone, last + 1)
    partner = (100 + percent) * (n - position) // percent - n
    use = 100 * partner >= percent * n
    records = np.empty(int(use.sum()), _RECORD)
    records["token"], records["node"], records["least"], records["partner"] = keys[::-1][: last + 1 - alone][use], node, n, partner[use]
    return records


def _grouped(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records in order of token and size, with the starts and lengths of the tokens."""
    records = records[np.lexsort((records["least"], records["token"]))]
    return records, *_runs(records["token"])


def _chained(group: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple]]:
    """Edges and combined records of one token's records, taken as overlapping intervals.

    Two records can only link if each one's least size is within the other's
    largest partner, so sorted by size, whatever links lies in one interval.
    """
    edges, out = [], []
    for token, node, least, partner in group.tolist():
        if out and least <= out[-1][3]:
            edges.append((node, out[-1][1]))
            out[-1] = (token, out[-1][1], out[-1][2], max(partner, out[-1][3]))
        else:
            out.append((token, node, least, partner))
    return edges, out


def _combined(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and the records left when those of one token, if more than COMBINED, are chained."""
    records, starts, lengths = _grouped(records)
    many, edges, fewer = lengths > COMBINED, [], []
    for a, n in zip(starts[many], lengths[many]):
        more, combined = _chained(records[a : a + n])
        edges += more
        fewer += combined
    return _distinct(np.array(edges, np.int64).reshape(-1, 2)), np.concatenate([records[np.repeat(~many, lengths)], np.array(fewer, _RECORD)])


def _meeting(records: np.ndarray, crowded: int) -> np.ndarray:
    """Edges that connect all nodes that may link: pairs that meet, for crowded tokens chains."""
    records, starts, lengths = _grouped(records)
    edges = []
    for a, n in zip(starts[lengths > crowded], lengths[lengths > crowded]):
        edges += _chained(records[a : a + n])[0]
    few = records[np.repeat((lengths > 1) & (lengths <= crowded), lengths)]
    pairs, step = [np.array(edges, np.int64).reshape(-1, 2)], 1
    while len(few) > step:
        one, other = few[:-step], few[step:]
        same = one["token"] == other["token"]
        if not same.any():
            break
        ok = same & (other["least"] <= one["partner"]) & (one["least"] <= other["partner"]) & (one["node"] != other["node"])
        pairs.append(np.stack([one["node"][ok], other["node"][ok]], 1))
        step += 1
    return _distinct(np.concatenate(pairs))


def _distinct(edges: np.ndarray) -> np.ndarray:
    return np.unique(np.sort(edges, axis=1), axis=0)


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (comp, rep, n, …) with a ``block`` of bounded size and the number of blocks."""
    sizes = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("_size"), F.sum("n").alias("_tokens"))
    blocks = F.greatest(F.ceil(F.col("_size") / BLOCK), F.ceil(F.col("_tokens") / BLOCK_TOKENS))
    joined = skew_join(rows, sizes.withColumn("blocks", blocks), "comp", "_size", max(1, rows.count()))
    return joined.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("_size", "_tokens")


def _linked(sets: DataFrame, bins: int, percent: int) -> DataFrame:
    """Links (a, b) inside each (comp, block, other) of ``sets``, many of them to a task.

    Sets have rep, label, n, keys, stored, probing.
    """

    def work(table: pa.Table) -> pa.Table:
        groups: dict[tuple, dict] = {}
        names = ("comp", "block", "other", "rep", "label", "n", "keys", "stored", "probing")
        for comp, block, other, rep, *rest in zip(*(table.column(c).to_pylist() for c in names)):
            groups.setdefault((comp, block, other), {})[rep] = rest
        links = []
        for group in groups.values():
            reps = sorted(group)
            labels, sizes, keys, stored, probing = zip(*(group[r] for r in reps))
            arrays = [np.frombuffer(t, np.uint64) for t in keys]
            links += [(reps[i], reps[j]) for i, j in spanning_links(arrays, list(sizes), list(labels), list(stored), list(probing), percent)]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    bin_of = F.pmod(F.xxhash64("comp", "block", "other"), F.lit(bins))
    return sets.withColumn("_bin", bin_of).groupBy("_bin").applyInArrow(work, "a long, b long")


def _relabel(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with their label replaced by that of its component under ``links``."""
    found = components(links.select("a", "b"))
    sized = found.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("_size")), found.node == F.col("label")).select("label", "component", "_size")
    total = max(1, rows.count())
    moved = skew_join(rows, sized, "label", "_size", total).withColumn("label", F.col("component")).drop("component", "_size")
    hot = F.broadcast(sized.filter(F.col("_size") > total / 1000))
    kept = rows.join(hot, "label", "left_anti").join(sized, "label", "left_anti")
    return moved.select(*rows.columns).unionByName(kept.select(*rows.columns))


def links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between class representatives that span the components.

    ``sets`` are those of :func:`ordered_sets`, ``groups`` (node, component) the candidate groups.
    """
    spark = sets.sparkSession
    slim = sets.select("rep", "n").join(groups, F.col("rep") == F.col("node")).select("rep", "n", F.col("component").alias("comp")).dropDuplicates(["rep"])
    placed = cut(_blocked(slim))
    count = placed.count()
    side = F.broadcast(placed) if count <= BROADCAST_ROWS else placed
    sets = cut(sets.select("rep", "keys").join(side, "rep"))
    bins = lambda n: max(partitions(spark), -(-n // BLOCK))
    both = lambda df: df.select("comp", "block", F.lit(-1).cast("long").alias("other"), "rep", F.col("rep").alias("label"), "n", "keys", F.lit(True).alias("stored"), F.lit(True).alias("probing"))
    found = [cut(_linked(both(sets), bins(count), percent))]
    large = sets.filter("blocks > 1")
    if large.isEmpty():
        return found[0]
    labels = cut(_relabel(large.select("rep", "comp", "n", F.col("rep").alias("label")).dropDuplicates(["rep"]), found[0]))
    while True:
        roots = cut(labels.filter("rep = label").select("rep", "comp", "n"))
        count = roots.count()
        more = cut(_linked(both(_blocked(roots).join(large.select("rep", "keys"), "rep")), bins(count), percent))
        found.append(more)
        labels = cut(_relabel(labels, more))
        if labels.filter("rep = label").count() > 0.7 * count:
            break
    mixed = labels.groupBy("comp").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one <> other").select("comp")
    left = cut(large.join(labels.join(mixed, "comp").select("rep", "label"), "rep"))
    if left.isEmpty():
        return union(found)
    found.append(cut(_linked(_crossing(left, percent), bins(8 * left.count()), percent)))
    return union(found)


def _crossing(left: DataFrame, percent: int) -> DataFrame:
    """What blocks' trees have yet to decide: rows for :func:`_linked`, with the probe's own block as ``other``.

    ``left`` are sets (comp, block, rep, label, n, keys) of groups of many blocks. Of
    the sets on a rare shingle, those outside its most frequent component probe
    the other blocks that have sets of another component on it.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [rare(np.frombuffer(k, np.uint64), rep, n, percent) for k, rep, n in zip(*(batch.column(c).to_pylist() for c in ("keys", "rep", "n")))]
            records = np.concatenate([np.empty(0, _RECORD), *own])
            at = pa.array(np.repeat(np.arange(len(own)), [len(r) for r in own]))
            columns = {c: batch.column(c).take(at) for c in ("comp", "block", "label")}
            sizes = {c: pa.array(records[c].astype(np.int64)) for c in ("least", "partner")}
            yield _batch(token=_longs(records["token"]), rep=_longs(records["node"]), **columns, **sizes)

    members = left.select("rep", "n", "keys", "comp", "block", "label").mapInArrow(spread, "token long, rep long, comp long, block long, label long, least long, partner long")
    # a shingle in a group; were two to share a hash, their sets would only be tried in vain
    members = cut(members.withColumn("spot", F.xxhash64("comp", "token")).drop("token"))
    shares = members.groupBy("spot", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = shares.groupBy("spot").agg(F.max(F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size")).filter("parts > 1")
    mixed = cut(mixed.select("spot", F.col("most.label").alias("top"), "size"))
    members = cut(skew_join(members, mixed, "spot", "size", max(1, members.count())).drop("size"))
    homes = members.groupBy("comp", "spot", F.col("block").alias("home")).agg(
        F.min("label").alias("one"), F.max("label").alias("another"), F.min("least").alias("least_there"), F.max("partner").alias("partner_there")
    )
    outside = members.filter("label <> top").join(homes, ["comp", "spot"])
    outside = outside.filter("home <> block and (one <> label or another <> label) and least_there <= partner and least <= partner_there")
    probes = cut(outside.select("comp", "home", F.col("block").alias("other"), "rep").distinct())
    trees = probes.select("comp", F.col("home").alias("block"), "other").distinct()
    stored = members.select("rep").distinct().join(left, "rep").join(trees, ["comp", "block"])
    probing = probes.select("rep", F.col("home"), "other").join(left.drop("block"), "rep").withColumnRenamed("home", "block")
    fields = ("comp", "block", "other", "rep", "label", "n", "keys")
    return stored.select(*fields, F.lit(True).alias("stored"), F.lit(False).alias("probing")).unionByName(
        probing.select(*fields, F.lit(False).alias("stored"), F.lit(True).alias("probing"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, class_id.

    ``component_id`` is the smallest id reachable by links, its own included;
    ``class_id`` the smallest id with an equal set. Null or empty texts have no
    shingles and link with nothing; repeated rows keep their rows; a set that only
    rows without id have links with nothing; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = max(partitions(spark), size // (12 * BUCKET))  # a word has about six bytes; half of the shingles are sent
    described = cut(describe(docs, id_col, text_col, buckets, width, percent))
    own = described.filter("bucket is null").select("doc_id", "n", "hi", "lo", "chunk", "owner").withColumn("key", F.concat_ws(":", "n", "hi", "lo"))
    classes = cut(
        own.filter("n > 0").groupBy("key", "n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    )
    able = own.filter("n > 0").join(open_sets(described), ["chunk", "owner"]).groupBy("key").agg(F.first("n").alias("n"), F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.min("doc_id").alias("rep"))
    able = cut(able.filter("rep is not null"))
    tokens = able.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sets, edges = ordered_sets(docs, able.select("rep", "hi", "lo"), tokens, id_col, text_col, width, percent)
    found = components(links(sets, components(edges), percent))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "size", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")
    )
    some = skew_join(own.filter("n > 0"), cut(named), "key", "size", max(1, own.count()))
    some = some.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    none = own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return some.unionByName(none)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Documents with null ids stay, as do rows that repeat a kept id.
    """
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone = fresh_name(docs)
    lost = cut(found.filter("doc_id > component_id").select(F.col("doc_id").alias(gone)).distinct())
    side = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    return docs.join(side, docs[f"`{id_col}`"].cast("long") == side[gone], "left_anti")
