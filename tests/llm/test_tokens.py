from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from peakloom.llm import packing, token_files, tokens
from peakloom.llm.queries import vocabulary
from peakloom.llm.tokens import Encoder

from . import brute


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    rng = random.Random(2)
    signs = [*"ab  \n\t.,!'sé1\x1c　́İſ<|>", " ", "'re ", "<|endoftext|>", "Σ ", "word ", "Word. ", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    plain, own = brute.tokenizer(name), Encoder(vocabulary(name))
    assert own.pattern is not None
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for size in (4000, 7):
        for at in range(0, len(texts), size):
            ids, ends = own.encode_batch(texts[at : at + size])
            for k, text in enumerate(texts[at : at + size]):
                assert ids[ends[k] : ends[k + 1]].tolist() == want[at + k], repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_plain_character(name):
    """Each character that is split here, in several places, gives the library's ids."""
    plain, own = brute.tokenizer(name), Encoder(vocabulary(name))
    signs = [chr(c) for c in range(0x250) if tokens._PLAIN.fullmatch(chr(c))]
    assert len(signs) > 450
    texts = [form.replace("_", c) for c in signs for form in ("_", "a_b", " _", "x _y", "1_2", "__ ", "A_'s", "._!")]
    ids, ends = own.encode_batch(texts)
    for k, want in enumerate(plain.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == want.ids, repr(texts[k])


def test_encoder_leaves_other_vocabularies_to_the_library(tmp_path):
    """Where the file's way of splitting isn't known, whole texts go to the library."""
    made = json.loads(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    made["pre_tokenizer"]["use_regex"] = False
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    own, plain, texts = Encoder(str(path)), tokenizers.Tokenizer.from_file(str(path)), ["one two", "", "a  b's", None]
    assert own.pattern is None
    ids, ends = own.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain.encode(t or "").ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_split_equals_pattern(name):
    """Plain texts are split at once where the vocabulary's pattern splits them one by one."""
    rng, own = random.Random(4), Encoder(vocabulary(name))
    signs = [*"aZ  \n\t.,!''sTmD1²½\xadéÉŸǄ", "  ", "'re", "'VE", "'ll ", "'l", "'r"]
    texts = ["", *("".join(c for c in (rng.choice(signs) for _ in range(rng.randint(0, 12))) if tokens._PLAIN.fullmatch(c)) for _ in range(20000)), ""]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    text, starts, before = tokens.split(np.frombuffer(raw, np.uint8), offsets, own.folds)
    pieces = [text[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(text)])]
    for t, a, b in zip(texts, before, before[1:]):
        assert pieces[a:b] == own.pattern.findall(t.lower() if own.folds else t), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_that_is_not_plain(name):
    """Texts aren't cut before white space of any kind, nor is one text joined to the next."""
    plain, own = brute.tokenizer(name), Encoder(vocabulary(name))
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [form.replace("_", c) for c in spaces for form in ("a _b", "a  _ b", "_", "a _", " _中 a", "中 _é 's", "क _ क")]
    for batch in (texts, [*reversed(texts)]):
        ids, ends = own.encode_batch(batch)
        for k, want in enumerate(plain.encode_batch(batch, add_special_tokens=False)):
            assert ids[ends[k] : ends[k + 1]].tolist() == want.ids, repr(batch[k])


def test_encoder_knows_pieces():
    """What is encoded grows with the distinct pieces, not with the ways that they stand together or are written."""
    own = Encoder(vocabulary("word_bpe_49k.json"))
    words, marks = [a + b for a in "abcdefgh" for b in "ijklmnop"], [",", ".", "!\n", ":\nAnd"]
    own.encode_batch([f"{form(w)}{m}{x}" for w in words for m in marks for x in ("", "Or") for form in (str.lower, str.title, str.upper)])
    assert len(own.ends) - 1 == len(words) + 4 + 3  # the marks "," "." "!" ":", and "or", "and", "andor"


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 3)
    own = Encoder(vocabulary("word_bpe_49k.json"))
    first = own.encode_batch(["one two three four five"])[0].tolist()
    assert own.encode_batch(["one two three four five"])[0].tolist() == first and len(own.ends) == 6


def test_encoder_forgets_long_parts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_IDS", 50)
    own = Encoder(vocabulary("word_bpe_49k.json"))
    for sign in "中文字":
        own.encode_batch([sign * 60])
        assert len(own.known) == 1


def test_lists_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_IDS", 4)
    ids, ends = np.arange(14, dtype=np.uint32), np.array([0, 1, 3, 4, 10, 10, 13, 14])
    parts = tokens.in_lists(ids, ends)
    assert [x for _, lists in parts for x in lists.to_pylist()] == [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert [(s.start, s.stop) for s, _ in parts] == [(0, 3), (3, 4), (4, 7)]


def check_packed(rows, got, length):
    t = brute.tokenizer("byte_bpe_50k.json")
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, text, *_ in rows:
        ids, own = brute.ids_of(t, text), sorted(pieces[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > length)
        assert all(r["length"] == length for r in own[1:])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), sum(r["length"] for r in got)


def test_packing(docs, rows):
    got = packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"))).collect()
    n, tokens = check_packed(rows, got, 1024)
    assert n <= -(-tokens // 1024) * 1.02 + 1


def test_packing_in_rounds(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 12)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    got = packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), length=256), length=256).collect()
    n, tokens = check_packed(rows, got, 256)
    assert n <= -(-tokens // 256) * 1.1 + 2  # a dozen items to a task leave more room than the thousands of real runs


def test_packing_goes_on_while_bins_fit(spark, monkeypatch):
    """Small bins of many partitions come together, however few they are."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    rows = [(i, 0, 0, 12 if i % 51 == 0 else 90, 0) for i in range(408)]
    got = packing.pack(spark.createDataFrame(rows, packing._PIECES), length=100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(408)) and len({r["sequence_id"] for r in got}) == 401


def test_packing_edges(spark, none):
    assert packing.pack(packing.pieces(none, vocabulary("byte_bpe_50k.json"))).count() == 0
    twice = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    got = packing.pack(packing.pieces(twice, vocabulary("byte_bpe_50k.json"))).collect()
    assert len(got) == 3 and sorted(r["offset"] for r in got) == [0, 1, 2] and len({r["sequence_id"] for r in got}) == 1


def test_best_fit():
    bins = packing.best_fit([5, 5, 4, 3, 3, 2, 1, 1], 8)
    sizes = [5, 5, 4, 3, 3, 2, 1, 1]
    assert sorted(i for b in bins for i in b) == list(range(8)) and len(bins) == 3
    assert all(sum(sizes[i] for i in b) <= 8 for b in bins)


def test_token_files(spark, docs, rows, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, vocabulary("word_bpe_49k.json"))
    t, at, expected = brute.tokenizer("word_bpe_49k.json"), 0, []
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = brute.ids_of(t, text)
        expected.append((d, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_files.token_index(spark, path).collect())) == expected
    some = rows[20]
    found = token_files.read_tokens(spark, path).filter(F.col("doc_id") == some[0]).first()
    assert found["ids"] == brute.ids_of(t, some[1])


def test_token_files_edges(spark, none, tmp_path):
    token_files.write_tokens(none, str(tmp_path / "none"), vocabulary("word_bpe_49k.json"))
    assert token_files.token_index(spark, str(tmp_path / "none")).count() == 0
    odd = spark.createDataFrame([(2, "x"), (None, None), (2, "x")], "doc_id long, text string")
    token_files.write_tokens(odd, str(tmp_path / "odd"), vocabulary("word_bpe_49k.json"))
    got = token_files.token_index(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 1), (2, 1, 2), (2, 3, 2)]


def test_token_files_skip_rows(spark, tmp_path):
    """The files have stripes, an index entry for every STRIDE rows, and Bloom filters; a reader of one document skips the rest."""
    path = str(tmp_path / "many")
    rows = spark.range(0, 60_000, 2, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.lit("some words")).alias("text"))
    token_files.write_tokens(rows, path, vocabulary("word_bpe_49k.json"))
    files = sorted(f for f in os.listdir(path) if f.endswith(".orc"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc.OrcFile
    for f in files:
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(f"{path}/{f}"), orc.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.STRIDE
        stripes = reader.getStripes()
        footer = reader.rows().readStripeFooter(stripes.get(0)).getStreamsList()
        kinds = {str(s.getKind()) for s in footer}
        assert any(k.startswith("BLOOM_FILTER") for k in kinds) and "ROW_INDEX" in kinds
    one = token_files.read_tokens(spark, path).filter("doc_id = 30000")
    assert one.count() == 1 and one.first()["n_tokens"] > 3
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,30000)]" in one._jdf.queryExecution().toString()
    assert token_files.read_tokens(spark, path).filter("doc_id = 30001").count() == 0
    one.collect()
    (scan,) = [leaf for leaf in _sequence(one._jdf.queryExecution().executedPlan().collectLeaves())]
    assert 1 <= scan.metrics().get("numOutputRows").get().value() <= token_files.STRIDE


def _sequence(items):
    return [items.apply(i) for i in range(items.size())]
