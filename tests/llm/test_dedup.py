from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from peakloom.llm import common, exact_dedup, ngram_join
from peakloom.llm.common import components
from peakloom.llm.prefix_tree import spanning_links

from . import brute


def test_exact_report(docs, rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    expected = sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    report = exact_dedup.duplicate_report(docs)
    assert sorted(map(tuple, report.collect())) == expected
    kept = {r[0] for r in expected if r[3]}
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == kept and left.count() == len(kept)


def test_exact_joins_by_shuffle_beyond_the_bound(docs, monkeypatch):
    want = sorted(map(tuple, exact_dedup.duplicate_report(docs).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_BYTES", 1)
    assert sorted(map(tuple, exact_dedup.duplicate_report(docs).collect())) == want


@pytest.mark.parametrize("bound", [32 << 20, 1])
def test_exact_leaves_texts_where_they_are(docs, monkeypatch, bound):
    """No shuffle carries texts, however large the filter; beyond the rows' bound one does, by hash and id."""
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_BYTES", bound)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    left = exact_dedup.drop_duplicates(docs)
    assert "Exchange hashpartitioning" not in plan(left) and "SortMergeJoin" not in plan(left)
    want = sorted(r["doc_id"] for r in left.collect())
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    shuffled = exact_dedup.drop_duplicates(docs)
    assert plan(shuffled).count("Exchange hashpartitioning") == 2 and sorted(r["doc_id"] for r in shuffled.collect()) == want


def test_exact_edges(spark, none):
    assert exact_dedup.duplicate_report(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    got = exact_dedup.duplicate_report(twice).collect()
    assert [r["kept"] for r in got].count(True) == 2 and {r["group_size"] for r in got} == {3, 2}
    assert sorted(map(repr, exact_dedup.drop_duplicates(twice).collect())) == ["Row(doc_id=1, text='x')", "Row(doc_id=None, text='y')"]


@pytest.mark.parametrize("local", [1_000_000, 1])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    edges = [(1, 2), (2, 3), (3, 1), (7, 7), (10, 11), (12, 11), (20, 15)] + [(100, k) for k in range(101, 400)] + [(k, k + 1) for k in range(500, 560)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[3] == 1 and got[7] == 7 and got[12] == 10 and got[20] == 15 and got[399] == 100 and got[560] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def expected(rows):
    sets = {d: brute.shingle_set(t) for d, t, *_ in rows}
    return {d: (len(sets[d]), c) for d, c in brute.components(sets).items()}


def as_map(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_ngram_join(docs, expected):
    got = ngram_join.near_duplicates(docs)
    assert got.count() == len(expected)
    assert as_map(got) == expected
    assert len({c for _, c in expected.values()}) < len(expected) - 20


@pytest.mark.parametrize(("block", "crowded", "combined", "chunk", "bucket"), [(2, 64, 4096, 2_000_000, 1000), (3, 2, 4096, 500, 1_000_000), (2, 1, 2, 2_000_000, 50)])
def test_ngram_join_in_blocks(docs, expected, monkeypatch, block, crowded, combined, chunk, bucket):
    for name, value in (("BLOCK", block), ("CROWDED", crowded), ("COMBINED", combined), ("CHUNK", chunk), ("BUCKET", bucket), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    assert as_map(ngram_join.near_duplicates(docs)) == expected


def test_ngram_edges(spark, none):
    assert ngram_join.near_duplicates(none).count() == 0
    lone = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "A  B"), (4, "A  B")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in ngram_join.near_duplicates(lone).collect()) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3)]
    assert {r["doc_id"] for r in ngram_join.drop_near_duplicates(lone).collect()} == {1, 2, 3}


def test_drop_near_duplicates(docs, expected):
    left = ngram_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {c for _, c in expected.values()}


def test_ngram_join_of_loose_groups(spark, monkeypatch):
    """Texts of a few common passages: groups of many blocks and components, with links near the bound."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "CROWDED", 3)
    rng = random.Random(11)
    passages = [" ".join(f"p{k}w{i}" for i in range(rng.randint(8, 30))) for k in range(7)]
    rows = [(i, " ".join(rng.sample(passages, rng.randint(2, 5)) + [f"own{i}"] * rng.randint(0, 1))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {d: brute.shingle_set(t) for d, t in rows}
    want = brute.components(sets)
    assert len(set(want.values())) > 20
    assert as_map(ngram_join.near_duplicates(df)) == {d: (len(sets[d]), c) for d, c in want.items()}


def test_one_shingle_of_very_many_texts(spark, monkeypatch):
    """Unrelated texts that share one passage are settled before any pair is made."""
    rng = random.Random(12)
    passage = "one two three four five six"
    rows = [(i, passage + " " + " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    described = ngram_join.describe(df, "doc_id", "text", 8).cache()
    assert ngram_join.open_sets(described).count() < 50
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == 5000 and all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 42 for r in got)


def test_tree_finds_every_link():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.choice(200, 40, replace=False)
        sets = []
        for _ in range(25):
            own = set(rng.choice(base, rng.integers(20, 40), replace=False)) | set(rng.choice(400, rng.integers(0, 12)))
            sets.append(np.array(sorted(own), np.uint64))
        for probing in (range(25), range(9)):
            inside = set(probing)
            both = len(inside) == 25
            extra = rng.integers(0, 3, 25)  # elements of one set alone need not be stored
            sizes = [len(s) + int(k) for s, k in zip(sets, extra)]
            plain = brute.components({i: set(s.tolist()) | {(i, k) for k in range(extra[i])} for i, s in enumerate(sets)})
            links = spanning_links(sets, sizes, list(range(25)), [both or i not in inside for i in range(25)], [i in inside for i in range(25)])
            if both:
                assert brute.components({i: {i} for i in range(25)}) and _joined(links) == plain
            for i, j in links:
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                assert 100 * len(a & b) >= 75 * (sizes[i] + sizes[j] - len(a & b))


def _joined(links):
    up = list(range(25))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links:
        x, y = root(i), root(j)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(25)}
