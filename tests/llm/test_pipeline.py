"""The pipeline's stages, each on what the last one kept."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import mixing, toxicity

from ..conftest import SMALL
from . import brute


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    tox, exact, near, mixed = seen.values()
    assert set(exact.values()) == set(tox.values()) and len(set(exact.values())) == len(exact)
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(whole, spark.read.parquet(f"{SMALL}/labels.parquet"))
    for d, text in whole.select("doc_id", "text").collect():
        p, _ = brute.severity(text, model)
        assert (d in tox) == (p < toxicity.REJECT) or abs(p - toxicity.REJECT) < 1e-3
    sets = {d: brute.shingle_set(t) for d, t in exact.items()}
    assert set(near) == set(brute.components(sets).values())
    before = whole.filter(F.col("doc_id").isin(list(near))).select("doc_id", "text", "lang", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id")).collect()
    shares, _ = brute.mixed([tuple(r) for r in before], mixing)
    for d, _, _, _, h in before:
        p, draw = shares[d][-1], (h + 2.0**63) / 2.0**64
        assert (d in mixed) == (draw < p) or abs(draw - p) < 1e-4
    assert mixed.keys() <= near.keys()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(mixed)
    t = brute.tokenizer("byte_bpe_50k.json")
    assert sum(r["length"] for r in rows) == sum(len(brute.ids_of(t, x)) for x in mixed.values())


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    folder = os.path.dirname(got.inputFiles()[0]).removeprefix("file:")
    assert os.listdir(os.path.dirname(folder)) == ["4"]  # the stages before are deleted
