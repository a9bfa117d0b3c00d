"""Toxicity: cumulative-link ordinal regression over sparse word features.

Features are a text's distinct words and their first letters; those that tell
the labels apart most are selected. One weight vector is shared by all ordered
thresholds: P(grade > k) = logistic(w·x - theta_k). The model is fitted on a
bounded sample of labelled rows and scores every document.

Labels say only toxic or not. The grades above 0 are thirds of the toxic sample
by the share of words that mark toxicity, and the markers are chosen on the same
sample. So severity orders toxic texts by how densely they are so, by this data's
own words; it isn't held against any judged severity, and only the first
threshold, toxic or not, can be checked against labels.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import cut, fresh_name, small_batches, text_of

#: Labelled rows used at most, of the toxic and of the others.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 12_000
FEATURES = 4096
#: Documents of the sample that must have a feature.
MIN_SUPPORT = 4
#: Standard errors by which a selected feature's log odds differ from 0.
MIN_STRENGTH = 2.5
#: Penalty on squared weights.
PENALTY = 0.3
PREFIXES = (2, 3, 4, 5)
GRADES = 3
#: P(grade > 0) from which a document is rejected.
REJECT = 0.2
CACHE_WORDS = 500_000
_EDGES = re.compile(r"^\W+|\W+$")


def word_features(word: str) -> tuple[str, ...]:
    """The features of one white-space-delimited word, already in lower case."""
    core = _EDGES.sub("", word)
    if not core:
        return ()
    return (core, *(core[:k] + "-" for k in PREFIXES if len(core) > k))


def _distinct(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _counts(words: set[str], lookup) -> dict[int, int]:
    out: dict[int, int] = {}
    for found in filter(None, map(lookup, words)):
        for f in found:
            out[f] = out.get(f, 0) + 1
    return out


class _Lookup(dict):
    """Word to the indices of its selected features, cached."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(i for f in word_features(word) if (i := self.index.get(f)) is not None)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


@dataclass
class OrdinalModel:
    """Selected features, their shared weights, and the ordered thresholds."""

    features: list[str]
    weights: np.ndarray
    length_weight: float
    thresholds: np.ndarray

    def raw_score(self, words: set[str], lookup: "_Lookup") -> float:
        """The linear score of a text's distinct words."""
        found = _counts(words, lookup.__getitem__)
        score = self.length_weight * np.log1p(len(words))
        if found:
            score += float(np.log1p(np.fromiter(found.values(), float)) @ self.weights[np.fromiter(found, np.int64)])
        return score

    def exceed(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, least: float = 1e-6, steps: int = 300, memory: int = 12) -> np.ndarray:
    """Where the smooth function ``f``, which gives value and gradient, is least, by L-BFGS from ``x``.

    Stops when no part of the gradient is over ``least``, or after ``steps``.
    """
    value, slope = f(x)
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() <= least:
            break
        way, parts = slope.copy(), []
        for s, y in reversed(seen):
            parts.append((s @ way) / (s @ y))
            way -= parts[-1] * y
        way *= (seen[-1][0] @ seen[-1][1]) / (seen[-1][1] @ seen[-1][1]) if seen else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), part in zip(seen, reversed(parts)):
            way += (part - (y @ way) / (s @ y)) * s
        step, fall = 1.0, slope @ way
        while (new := f(x - step * way))[0] > value - 1e-4 * step * fall and step > 1e-12:
            step /= 2
        moved, turned = -step * way, new[1] - slope
        if moved @ turned > 1e-14:
            seen = [*seen[1 - memory :], (moved, turned)]
        x, (value, slope) = x + moved, new
    return x


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, lengths: np.ndarray, grades: np.ndarray, features: int, levels: int, l2: float = PENALTY, weights: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, the length's weight and thresholds of greatest penalised likelihood in the cumulative-link model.

    Thresholds are a first one and positive gaps, so they stay in order.
    ``weights`` say how many rows of the whole each row stands for, on average 1.
    """
    n = len(grades)
    weigh = np.ones(n) if weights is None else weights * n / weights.sum()
    at, has_low, has_high = (np.arange(n), grades), grades > 0, grades < levels

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b, first, gaps = x[:features], x[features], x[features + 1], np.exp(np.clip(x[features + 2 :], -20, 20))
        theta = first + np.r_[0.0, np.cumsum(gaps)]
        score = np.bincount(rows, values * w[columns], n) + b * lengths
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -40, 40)))
        likely = np.maximum(np.c_[np.ones(n), p][at] - np.c_[p, np.zeros(n)][at], 1e-12)
        change = p * (1 - p)
        # d log P / d z_k: the threshold below the grade pushes up, the one above down
        gz = np.zeros_like(p)
        gz[has_low, grades[has_low] - 1] += change[has_low, grades[has_low] - 1] / likely[has_low]
        gz[has_high, grades[has_high]] -= change[has_high, grades[has_high]] / likely[has_high]
        gz *= weigh[:, None]
        gs, gt = gz.sum(1), -gz.sum(0)
        g_gaps = np.array([gt[k + 1 :].sum() for k in range(levels - 1)]) * gaps
        up = np.r_[np.bincount(columns, values * gs[rows], features) - l2 * w, gs @ lengths - l2 * b, gt.sum(), g_gaps]
        return -(weigh @ np.log(likely) - l2 / 2 * (w @ w + b * b)) / n, -up / n

    x = minimised(loss, np.r_[np.zeros(features + 1), 2.0, np.zeros(levels - 1)])
    return x[:features], float(x[features]), x[features + 1] + np.r_[0.0, np.cumsum(np.exp(np.clip(x[features + 2 :], -20, 20)))]


def marked(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic``: 1 for each labelled document that any label calls toxic, else 0."""
    return labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """At most SAMPLE_TOXIC toxic and SAMPLE_CLEAN other labelled rows (key, text, toxic), by id hash."""
    marks = marked(labels).withColumn("_h", F.xxhash64(F.lit(7), "doc_id"))
    chosen = marks.filter("toxic = 1").orderBy("_h").limit(SAMPLE_TOXIC).unionByName(marks.filter("toxic <> 1").orderBy("_h").limit(SAMPLE_CLEAN))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    return rows.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")  # at most the two bounds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grades: int = GRADES) -> OrdinalModel:
    """Fit on a bounded sample. A toxic row's grade, 1 to ``grades``, follows the share of its words that mark toxicity.

    Without labelled rows of both kinds the model gives every document grade 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = cut(labelled_sample(docs, labels, id_col, text_col))
    totals = dict(sample.groupBy("toxic").count().collect())
    whole = dict(marked(labels).groupBy("toxic").count().collect())
    if not totals.get(1) or not totals.get(0):
        return OrdinalModel([], np.zeros(0), 0.0, np.full(grades, 60.0))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in _distinct(text) for f in word_features(w)}:
                    seen.setdefault(f, [0, 0])[toxic == 1] += 1
            clean, toxic = zip(*seen.values()) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["feature", "clean", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(emit, "feature string, clean long, toxic long")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter(F.col("c") + F.col("t") >= MIN_SUPPORT)
    odds = F.log((F.col("t") + 0.5) / (totals[1] + 1)) - F.log((F.col("c") + 0.5) / (totals[0] + 1))
    strength = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    told = counted.withColumn("odds", odds).withColumn("z", strength).filter(F.abs("z") >= MIN_STRENGTH)
    top = told.orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES)
    chosen = top.select("feature", "odds", "z").collect()
    index = {r["feature"]: i for i, r in enumerate(chosen)}
    marks = {i for i, r in enumerate(chosen) if r["odds"] > 2.5 and r["z"] > 4}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(index)
        for batch in batches:
            ids, counts, words, hits = [], [], [], []
            for text in batch.column(0).to_pylist():
                own = _distinct(text)
                found = _counts(own, lookup.__getitem__)
                ids.append(list(found))
                counts.append(list(found.values()))
                words.append(len(own))
                hits.append(sum(any(f in marks for f in lookup[w]) for w in own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), batch.column(1)],
                names=["ids", "counts", "words", "hits", "toxic"],
            )

    got = sample.select("text", "toxic").mapInArrow(sparse, "ids array<int>, counts array<int>, words long, hits long, toxic int").toPandas()
    sizes = got["ids"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(got)), sizes)
    columns = np.concatenate(got["ids"].to_numpy()).astype(np.int64)
    values = np.log1p(np.concatenate(got["counts"].to_numpy()).astype(float))
    toxic = got["toxic"].to_numpy() == 1
    density = got["hits"].to_numpy() / np.maximum(1, got["words"].to_numpy())
    borders = np.quantile(density[toxic], np.arange(1, grades) / grades)
    grade = np.where(toxic, 1 + np.searchsorted(borders, density, side="right"), 0)
    lengths = np.log1p(got["words"].to_numpy().astype(float))
    stands_for = np.where(toxic, whole[1] / totals[1], whole[0] / totals[0])  # else a bounded sample would change the share of toxic rows
    w, b, theta = fit_ordinal(rows, columns, values, lengths, grade, len(chosen), grades, weights=stands_for)
    return OrdinalModel([r["feature"] for r in chosen], w, b, theta)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, expected_severity, p_toxic, grade, rejected.

    ``expected_severity`` is the sum of P(grade > k); ``grade`` the most likely
    one. Null text counts as empty; repeated rows and null ids keep their rows; an
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _scored(rows, model, ["doc_id"], "text", ["expected_severity", "p_toxic", "grade", "rejected"])


def clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever their names."""
    names = [fresh_name(docs, f"_{n}") for n in ("severity", "toxic", "grade", "rejected")]
    scored = _scored(docs, model, docs.columns, text_col, names)
    return scored.filter(~F.col(names[3])).select([f"`{c}`" for c in docs.columns])


def _scored(docs: DataFrame, model: OrdinalModel, keep: list[str], text_col: str, names: list[str]) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # FEATURES strings and weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        lookup = _Lookup({f: i for i, f in enumerate(model.features)})
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                p = model.exceed(model.raw_score(_distinct(text), lookup))
                each = -np.diff(np.r_[1.0, p, 0.0])
                rows.append((float(p.sum()), float(p[0]), int(each.argmax()), bool(p[0] >= REJECT)))
            columns = list(zip(*rows)) or [()] * 4
            out = [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], names=[*keep, *names])

    kinds = {f.name: f for f in docs.schema}
    made = zip(names, (DoubleType(), DoubleType(), IntegerType(), BooleanType()))
    return docs.mapInArrow(work, StructType([*(kinds[c] for c in keep), *(StructField(n, t) for n, t in made)]))
