"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell, a combination of source, language and topic. Cell
weights are raked to the target share of each margin in turn until they agree
with all; documents are then sampled by a hash of their id with the probability
that their cell's weight, scaled to the token budget, asks for.

Topics come from the texts. Words are hashed to CELLS features, whose document
frequencies over the whole corpus are counted first. The TOPICS most frequent
ones that at most COMMON of the documents have are the topics' anchors, and a
document's topic is the anchor that it has most, weighed by rarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, distinct, fresh_name, gathered, skew_join, small_batches, union

#: Cells that are raked on the driver; more are raked by DataFrame steps.
LOCAL_CELLS = 100_000
#: Values of a margin whose sums are broadcast.
LOCAL_VALUES = 100_000
SWEEPS, TOLERANCE = 60, 1e-9
#: A target share is proportional to the tokens to this power, where none is given.
TEMPER = 0.7
#: Part of all tokens that the sample should have.
BUDGET = 0.7
MARGINS = ("source", "lang", "topic")
SEED = 17
#: Hashed word features, topics, and the part of documents beyond which a feature tells no topic.
CELLS, TOPICS, COMMON = 1 << 14, 24, 0.05
#: Documents that an anchor must be in.
LEAST = 3
_MARKS = ".,;:!?\"'()[]#$%&*|"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its text and feature, and the texts' numbers of words.

    Words stand between single spaces or line ends, so an empty text has one, of
    no characters. A feature is the hash of the word without case and outer marks.
    """
    spaced = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", " ")
    split = pc.split_pattern(spaced, " ")
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    plain = pc.utf8_trim(words.dictionary, _MARKS).to_pylist()
    features = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % CELLS for w in plain), np.int64, len(plain))
    return np.repeat(np.arange(len(counts)), counts), features[words.indices.to_numpy()], counts


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents by feature, over all of them, and their number; CELLS numbers reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(CELLS, np.int64), 0
        for table in gathered(batches, "text"):
            at, feature, counts = words_of(table.column(0).combine_chunks())
            total += np.bincount(distinct(at * CELLS + feature) % CELLS, minlength=CELLS)
            rows += len(counts)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, has]), pa.array(np.r_[rows, total[has]])], names=["feature", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(CELLS, np.int64), 0
    for feature, n in counted.collect():
        if feature < 0:
            rows = n
        else:
            out[feature] = n
    return out, rows


def anchors(documents: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The topics' features, most frequent first, and the weight of each: the log of its rarity."""
    able = np.flatnonzero((documents >= LEAST) & (documents <= COMMON * rows))
    chosen = able[np.lexsort((able, -documents[able]))][:TOPICS]
    return chosen, np.log(rows / documents[chosen]) if len(chosen) else np.empty(0)


def topics_of(texts: pa.Array, chosen: np.ndarray, weights: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each text's topic, the name of its anchor or ``other``, and its number of words."""
    at, feature, counts = words_of(texts)
    k = len(chosen)
    if not k or not len(counts):
        return ["other"] * len(counts), counts
    topic = np.full(CELLS, -1)
    topic[chosen] = np.arange(k)
    topic = topic[feature]
    found = np.bincount((at * k + topic)[topic >= 0], minlength=len(counts) * k).reshape(-1, k) * weights
    best = found.argmax(1)
    names = [f"t{c}" for c in chosen]
    return [names[b] if f > 0 else "other" for b, f in zip(best.tolist(), found.max(1).tolist())], counts


def with_topics(docs: DataFrame, text_col: str, found: tuple[np.ndarray, np.ndarray], keep: list[str], topic: str, tokens: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, and each document's topic and tokens under the names given."""
    kinds = {f.name: f for f in docs.schema}
    schema = StructType([*(kinds[c] for c in keep), StructField(topic, StringType()), StructField(tokens, LongType())])
    text, names = fresh_name(docs, "_text"), schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, text):
            topics, counts = topics_of(table.column(text).combine_chunks(), *found)
            kept = [table.column(i).combine_chunks() for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(topics, pa.string()), pa.array(counts)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text)).mapInArrow(work, schema)


def targets(cells: DataFrame, margin: str, given: dict[str, float] | None, temper: float = TEMPER) -> DataFrame:
    """``margin, target``: shares that sum to 1; values without a given share get none."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("_n"))
    if given is None:
        raw = sums.select(margin, F.pow(F.col("_n").cast("double"), F.lit(temper)).alias("_raw"))
    else:
        known = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{margin} string, _raw double")
        raw = sums.join(known, margin, "left").select(margin, F.coalesce("_raw", F.lit(0.0)).alias("_raw"))
    total = raw.agg(F.sum("_raw").alias("_total"))
    return raw.join(F.broadcast(total)).select(margin, (F.col("_raw") / F.col("_total")).alias("target"))


def rake_local(codes: list[np.ndarray], tokens: np.ndarray, shares: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Cell weights, summing to 1, whose margins are ``shares``, and how far the margins are from them.

    Targets that no weights meet leave a difference after SWEEPS.
    """
    w = tokens / tokens.sum()
    for _ in range(SWEEPS):
        worst = 0.0
        for code, share in zip(codes, shares):
            now = np.bincount(code, w, len(share))
            factor = np.divide(share, now, out=np.zeros_like(share), where=now > 0)
            worst = max(worst, float(np.abs(now - share).max()))
            w = w * factor[code]
        if worst < TOLERANCE:
            break
    w = w / w.sum() if w.sum() else w
    return w, max((float(np.abs(np.bincount(c, w, len(s)) - s).max()) for c, s in zip(codes, shares)), default=0.0)


def scale_local(w: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * w / tokens) whose expected tokens are the budget's share."""
    ratio, goal = w / tokens, budget * tokens.sum()
    low, high = 0.0, 1.0 / max(1e-300, ratio[ratio > 0].min(initial=1.0))
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if (np.minimum(1, c * ratio) * tokens).sum() < goal else (low, c)
    return np.minimum(1, high * ratio)


def _sums(now: DataFrame, margin: str, share: DataFrame) -> DataFrame:
    return now.groupBy(margin).agg(F.sum("w").alias("_now"), F.count(F.lit(1)).alias("_size")).join(share, margin)


def rake_frame(cells: DataFrame, shares: dict[str, DataFrame], sweeps: int = SWEEPS) -> tuple[DataFrame, float]:
    """:func:`rake_local` as DataFrame steps, for more cells than a driver should hold.

    A sweep over all margins is one plan and one checkpoint, of which the
    difference from the targets is taken in one more action.
    """
    count = cells.count()
    small = {m: s.count() <= LOCAL_VALUES for m, s in shares.items()}
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    now, worst = cells.withColumn("w", F.col("tokens") / F.lit(float(whole))), 0.0
    for _ in range(sweeps):
        for margin, share in shares.items():
            sums = _sums(now, margin, share)
            joined = now.join(F.broadcast(sums), margin) if small[margin] else skew_join(now, cut(sums), margin, "_size", max(1, count))
            factor = F.when(F.col("_now") > 0, F.col("target") / F.col("_now")).otherwise(0.0)
            now = joined.withColumn("w", F.col("w") * factor).select(*cells.columns, "w")
        now = cut(now)
        far = [_sums(now, m, s).agg(F.max(F.abs(F.col("_now") - F.col("target"))).alias("far")) for m, s in shares.items()]
        worst = max(r[0] or 0.0 for r in union(far).collect())  # one number for each margin
        if worst < TOLERANCE:
            break
    return now, worst


def scale_frame(cells: DataFrame, budget: float) -> DataFrame:
    """:func:`scale_local` on a frame with tokens and w; each action tries 64 factors."""
    ratio = F.col("w") / F.col("tokens")
    goal, least = cells.agg(F.sum("tokens") * F.lit(budget), F.min(F.when(ratio > 0, ratio))).first()
    low, high = 0.0, 1.0 / least if least else 1.0
    for _ in range(9):
        tried = [low + (high - low) * k / 64 for k in range(1, 65)]
        sums = cells.agg(*[F.sum(F.least(F.lit(1.0), ratio * c) * F.col("tokens")) for c in tried]).first()
        first = next((k for k, x in enumerate(sums) if x is not None and x >= goal), 63)
        low, high = tried[first - 1] if first else low, tried[first]
    return cells.withColumn("p", F.least(F.lit(1.0), ratio * high))


def calibrated(cells: DataFrame, given: dict[str, dict[str, float]] | None = None, margins: tuple[str, ...] = MARGINS, budget: float = BUDGET, local: int = LOCAL_CELLS) -> tuple[DataFrame, float]:
    """``cells`` (margins, tokens, documents) with raked weight ``w`` and probability ``p``, and the difference from the targets."""
    shares = {m: targets(cells, m, (given or {}).get(m)) for m in margins}
    if cells.count() > local:
        raked, worst = rake_frame(cells, {m: cut(s) for m, s in shares.items()})
        return scale_frame(raked, budget), worst
    rows = cells.toPandas()
    if not len(rows):
        return cells.withColumn("w", F.lit(0.0)).withColumn("p", F.lit(0.0)), 0.0
    codes, wanted = [], []
    for m in margins:
        share = dict(shares[m].collect())
        values = sorted(share)
        at = {v: i for i, v in enumerate(values)}
        codes.append(rows[m].map(at).to_numpy())
        wanted.append(np.array([share[v] for v in values]))
    tokens = rows["tokens"].to_numpy(float)
    w, worst = rake_local(codes, tokens, wanted)
    rows["w"], rows["p"] = w, scale_local(w, tokens, budget)
    kinds = ", ".join(f"{m} string" for m in margins)
    fields = [*margins, "tokens", "documents", "w", "p"]
    return cells.sparkSession.createDataFrame(rows[fields], f"{kinds}, tokens long, documents long, w double, p double"), worst


def _value(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def _draw(id_col: str) -> Column:
    return (F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`")).cast("double") + 2.0**63) / 2.0**64


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Rows ``id, source, lang, topic, tokens`` without texts, written once, and the topics' anchors."""
    found = anchors(*frequencies(docs, text_col))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), _value("source").alias("source"), _value("lang").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return cut(with_topics(slim, "text", found, ["id", "source", "lang"], "topic", "tokens")), found


def cells_of(slim: DataFrame) -> DataFrame:
    return slim.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def _met(rows: DataFrame, cells: DataFrame, ready: DataFrame, cell: str, names: dict[str, str]) -> DataFrame:
    """``rows``, which have their cell's name in ``cell``, with the columns ``names`` of ``ready`` under their new names."""
    named = ready.select(F.concat_ws("\u0001", *MARGINS).alias(cell), *[F.col(c).alias(n) for c, n in names.items()])
    count, total = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum("documents"), F.lit(0))).first()
    if count <= LOCAL_CELLS:
        return rows.join(F.broadcast(named), cell)
    return skew_join(rows, cut(named), cell, names["documents"], max(1, total))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """A row per document: its cell, tokens, the cell's raked share, probability and whether it is kept.

    ``residual``, the same in all rows, is the largest difference of a margin's
    share from its target; over 0 where the targets can't be met together. Null
    text counts as empty, with one word; null source or lang as the value ''. A
    null id draws as one fixed value; rows that repeat an id share their draw. An
    empty table gives no rows; other columns are ignored.
    """
    slim, _ = measured(docs, id_col, text_col)
    cells = cut(cells_of(slim))
    ready, worst = calibrated(cells, given, MARGINS, budget)
    rows = slim.withColumn("cell", F.concat_ws("\u0001", *MARGINS))
    rows = _met(rows, cells, ready, "cell", {"documents": "documents", "w": "cell_share", "p": "probability"})
    return rows.select(
        F.col("id").alias("doc_id"), *MARGINS, "tokens", "cell_share", "probability",
        (_draw("id") < F.col("probability")).alias("kept"), F.lit(worst).alias("residual"),
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents that :func:`mix` keeps, with all their columns, whatever their names."""
    slim, found = measured(docs, id_col, text_col)
    cells = cut(cells_of(slim))
    ready, _ = calibrated(cells, given, MARGINS, budget)
    topic, tokens, cell, size, p = (fresh_name(docs, n) for n in ("_topic", "_tokens", "_cell", "_size", "_p"))
    rows = with_topics(docs, text_col, found, docs.columns, topic, tokens)
    rows = rows.withColumn(cell, F.concat_ws("\u0001", _value("source"), _value("lang"), F.col(topic)))
    rows = _met(rows, cells, ready, cell, {"documents": size, "p": p}).filter(_draw(id_col) < F.col(p))
    return rows.select([f"`{c}`" for c in docs.columns])
