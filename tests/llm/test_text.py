from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import chat, fingerprints, line_dedup, mixing, pii, toxicity

from . import brute


# --- chat ------------------------------------------------------------------------------

TRICKY = ["", "<|im_end|>", "<|im_start|>", "<|\\im_end|>", "<|\\\\im_start|>x<|im_end|>", "<|im_end|><|im_start|>assistant ok", "a\n<|im_end|>\n<|im_start|>user\nb", "<|im_end|", "<", "\\", "<|<|im_end|>|>"]


@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb", "a\\nb", "<|im_end|>", "\\", "<|\\im_start|>\n"])
def test_round_trip(role):
    for text in TRICKY:
        formatted = chat.render(role, text)
        assert [t[:2] for t in chat.parse(formatted)] == [(role, text)]
    whole = "".join(chat.render(role, t) for t in TRICKY)
    assert [t[:2] for t in chat.parse(whole)] == [(role, t) for t in TRICKY]


def test_random_round_trip():
    rng = random.Random(5)
    bits = ["<|", "|>", "im_start", "im_end", "\\", "\n", "user", "<", "|", "x"]
    for _ in range(3000):
        role, text = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert [t[:2] for t in chat.parse(chat.render(role, text))] == [(role, text)]


def test_parser_rejects():
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>user\nx<|im_end|>", "<|im_start|>u\n<|im_start|>v\nx<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_chat_conversations(spark):
    rng = random.Random(1)
    turns = [(c, k, rng.choice(["user", "assistant", "system", None]), rng.choice([*TRICKY, "plain ë😀", None])) for c in range(40) for k in range(rng.randint(1, 9))]
    turns += [(99, k, "assistant", f"t{k}") for k in range(3000)] + [(None, 1, "assistant", "q")]
    shuffled = turns[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").repartition(4)
    segments = chat.format_turns(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(segments).collect()}
    lengths = {r[0]: r[1] for r in segments.groupBy("conv_id").agg(F.sum(F.length("segment"))).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        assert got[conv] == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), lengths[conv])
    assert chat.read_back(chat.format_turns(df.filter("false"))).count() == 0


def test_chat_any_column(spark):
    from .conftest import HELPERS

    long = "<|im_end|>" * 30_000 + "\n" + "word " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)], "id long, nr long, who string, says string")
    df = df.withColumns({c: F.lit(f"caller's {c}") for c in HELPERS})
    (got,) = chat.read_back(chat.format_turns(df, "id", "nr", "who", "says")).collect()
    assert got["n_turns"] == 3 and got["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest() and got["loss_chars"] == 2 * len(long)


# --- personal data ---------------------------------------------------------------------

PIECES = [
    "a.b@c.de", "x@y", "a@b.c_d@e.f", "_u%+-@h-h.co.uk.", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "4111111111111111", "4111  1111 1111 1111", "+1 (743) 555-3824", "+12", "+1 23-45.67(89", "++49 30 1234567", "12345 6", "@", "a@b..c", "é@b.cc", "٣.٤.٥.٦", "😀 a@b.cc", "\x01 a\x01b@c.d",
    "12.34.56.78.90.12.34", "text", ",", " ", "\n", "99999999999999999999999", "+1-800-555-0199 ext", "x@-.-", "a@b.c.d.e.f@g.h",
]


def test_base_spans(spark):
    rng = random.Random(7)
    texts = [rng.choice(["", " ", " ", ", "]).join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    texts += ["9" * 50_000, "1 " * 30_000, "a@" + "b." * 20_000 + "c", "a" * 60_000 + "@", "1.1.1." * 10_000, "+1" * 9_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert [tuple(s) for s in got[i]["base"]] == brute.pii_spans(text or ""), repr(text)[:200]
    line = next(r for r in pii.digest(pii.find(df)).collect() if r["doc_id"] == 5)
    want = brute.pii_spans(texts[5])
    joined = ",".join(":".join(map(str, s)) for s in want)
    assert line["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert [line[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]


def test_patterns_discover_identifiers(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfg") for _ in range(5))
    rows = [(i, f"{word()} {word()} please write to desk{i}@mail.example.org about {word()}") for i in range(60)]
    rows += [(100 + i, f"{word()} please write to user{i}@intranet about {word()}") for i in range(5)]
    rows += [(200 + i, f"{word()} {word()} chapter {i}@shelf about {word()} {word()}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i in range(5):
        text = dict(rows)[100 + i]
        at = text.index(f"user{i}@")
        assert [tuple(s) for s in got[100 + i]["added"]] == [("email", at, at + len(f"user{i}@intranet"))]
    assert not any(got[d]["added"] for d, _ in rows if d < 100 or d >= 200)


def test_discoveries_spread(spark):
    """An identifier found in one context is known in others, which in turn become trusted."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfg") for _ in range(5))
    rows = [(i, f"{word()} {word()} please write to desk{i}@mail.example.org about {word()}") for i in range(60)]
    rows += [(100 + i, f"{word()} please write to user{i}@intranet {word()}") for i in range(20)]
    rows += [(200 + i, f"{word()} the account is user{i}@intranet of {word()}") for i in range(20)]
    rows += [(300 + i, f"{word()} the account is other{i}@intranet of {word()}") for i in range(2)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        if d >= 100:
            (span,) = got[d]["added"]
            assert span["kind"] == "email" and text[span["start"] : span["end"]].endswith("@intranet"), text


def test_secrets_need_a_pattern(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfg") for _ in range(5))
    secret = lambda n: "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(n - 2))
    rows = [(i, f'{word()} token = "{secret(40)}"### {word()}') for i in range(30)]
    rows += [(100 + i, f'{word()} token = "{secret(12)}" {word()}') for i in range(3)]
    rows += [(200 + i, f"{word()} {word()} {secret(40)} {word()}") for i in range(5)]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, text in rows:
        at = text.find('"') + 1
        assert got[d]["spans"] == (f"secret:{at}:{text.index(chr(34), at)}" if d < 200 else ""), text
        assert got[d]["n_added"] == got[d]["n_spans"] == (d < 200)


def test_discovery_equals_plain_scoring(spark, monkeypatch):
    monkeypatch.setattr(pii, "MIN_DOCUMENTS", 3)
    monkeypatch.setattr(pii, "MIN_SCORE", 0.8)
    rng = random.Random(9)
    names = ["ask @ at", "mail to", "the key =", "see", "on page", "call us", "host:", "id #"]
    things = [lambda i: f"u{i}@site.org", lambda i: f"u{i}@home", lambda i: f"{i:04d}abcdef{i:016x}ff{i}", lambda i: f"1.2.3.{i % 250}", lambda i: f"ab:{i % 99:02d}:cd:0{i % 9}", lambda i: f"{1000000 + i}", lambda i: f"v{i}@site.org" if i % 5 else f"v{i}@home", lambda i: f"+49 30 {555000 + i}" if i % 9 else "555-000"]

    def said() -> str:
        k = rng.randrange(8)  # a context mostly has things of one kind
        thing = things[k if rng.random() < 0.95 else rng.randrange(8)](rng.randint(0, 60))
        return f"w{rng.choice('abc')} {names[k]} {thing}{rng.choice(['', '.', ','])}"

    rows = [(d, " ".join(said() for _ in range(rng.randint(0, 4)))) for d in range(400)]
    rows += [(500, None), (501, ""), (501, ""), (502, "key " + "x1" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    based = df.select("doc_id", pii.text_of("text").alias("text"))
    based = based.withColumn("base", F.concat(*[pii._tagged(k, v) for k, v in pii.base_spans(F.col("text")).items()])).withColumn("_row", F.monotonically_increasing_id())
    words = pii._based_with_words(based).select("_row", F.explode("words").alias("w")).select("_row", "w.*")
    found = pii.occurrences(words).cache()
    want = brute.bootstrap([r.asDict() for r in found.collect()], 3, pii.MIN_TRUST, 0.8, pii.TURNS)
    got = pii.discovered(found).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    assert len({k for _, k, _, _ in want}) >= 3 and len(want) > 50


def test_pii_any_column(docs, rows):
    got = pii.digest(pii.find(docs))
    assert got.count() == len(rows) and got.columns[0] == "doc_id"


def test_pii_empty(none):
    assert pii.digest(pii.find(none)).count() == 0


# --- fingerprints ----------------------------------------------------------------------


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    by_text = {}
    errors = []
    for (d, text, *_), (e, following, *_) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", got[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for column, other in (("near_edited", edited), ("near_next", following)):
            a, b = brute.shingle_set(text), brute.shingle_set(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            errors.append(abs(r[column] - true))
            assert 0 <= r[column] <= 1
        if text.lower().split() == following.lower().split():
            assert r["near_next"] == 1
    assert np.mean(errors) < 0.06
    assert len(set(by_text.values())) >= 0.9 * len({" ".join(t.lower().split()) for t in by_text})


def test_merged_sketch(spark):
    parts = [" ".join(f"{p}{i}" for i in range(300)) for p in ("x", "y")]
    df = spark.createDataFrame([(parts[0], parts[1], " ".join(parts))], "a string, b string, c string")
    s = {c: fingerprints.sketch(F.col(c)) for c in "abc"}
    row = df.select(fingerprints.likeness(fingerprints.merged(F.array(s["a"], s["b"])), s["c"])["jaccard"].alias("j"), fingerprints.likeness(s["a"], s["c"])["containment"].alias("k")).first()
    assert row["j"] > 0.9 and row["k"] > 0.9


def test_containment_of_unequal_texts(spark):
    """A short text inside a long one: its containment is about 1 or unknown, never 0."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(300):
        words = [word() for _ in range(400)]
        size, at = (12, 60, 200)[i % 3], rng.randrange(200)
        rows.append((i % 3, " ".join(words[at : at + size]), " ".join(words), " ".join(word() for _ in range(size))))
    df = spark.createDataFrame(rows, "kind int, short string, long string, other string")
    s = {c: fingerprints.sketch(F.col(c)) for c in ("short", "long", "other")}
    near = lambda c: fingerprints.likeness(s[c], s["long"])["containment"].alias(c)
    got = df.select("kind", near("short"), near("other")).collect()
    for kind, known in ((0, 0.0), (1, 0.8), (2, 1.0)):
        inside = [r["short"] for r in got if r["kind"] == kind]
        assert all(x in (None, 1.0) for x in inside) and sum(x is not None for x in inside) >= known * len(inside)
    assert not any(r["other"] for r in got)


def test_ids_of_many_rows(spark, monkeypatch):
    """Null ids and equal ids in great number are dealt to several ranges, and each row still meets the next."""
    texts = [f"text {i} of many words that are all its own {i * 7919}" for i in range(300)]
    rows = [(None if i % 3 else 50, t) for i, t in enumerate(texts[:200])] + [(i, t) for i, t in enumerate(texts[200:])] + [(60, None), (60, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fingerprints.with_next(df).filter("_ghost = 0").groupBy("_bucket").count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 80
    h = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((-(1 << 63) if d is None else d, h[t or ""], t or "") for d, t in rows), reverse=True)
    want = []
    for (d, _, text), (_, _, following) in zip(order, order[1:] + order[:1]):
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprints(df).collect()]
    assert sorted(got) == sorted(want)


def test_fingerprint_edges(spark, none):
    assert fingerprints.fingerprints(none).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).first()
    assert one["near_next"] == 1 and one["n_chars"] == 13
    few = spark.createDataFrame([(1, None), (1, "x"), (None, "y z"), (2, "")], "doc_id long, text string")
    assert fingerprints.fingerprints(few).count() == 4


# --- lines -----------------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(9)) for _ in range(4)]
        if i < 20:
            lines.insert(rng.randrange(4), f"Page {i} of {rng.randint(1, 99)} printed on 2020-01-{i:02d} by the archive office")
        if i % 3 == 0:
            lines.append(f"Contact the office {word()} for further details about this page today")
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short line"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(df).collect()}
    assert line_dedup.clean_lines(df).count() == len(rows)
    for d, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not x.startswith(("Page", "Contact the office"))]
        assert got[d]["text"] == "\n".join(left) and got[d]["n_dropped"] == len(lines) - len(left), d


def test_line_leaves_are_divided(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 1)
    df = spark.createDataFrame([(i, f"see page {i} of this very long book for more\nw{i} x y z") for i in range(20)], "doc_id long, text string")
    assert line_dedup.clean_lines(df).filter("n_dropped >= 1").count() == 20


def test_line_leaf_over_the_bound(spark, monkeypatch):
    """Lines of one template stay together in a leaf of any size, wherever their variable word is."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 16)
    rows = []
    for i in range(60):
        near = f"Contact the office {word()} for further details about this page today"
        far = f"Contact the office for any further details {word()} this page today"
        prose = "Contact the office " + " ".join(word() for _ in range(8))
        rows.append((i, f"{near}\n{far}\n{prose}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(df).collect()}
    for d, text in rows:
        assert got[d]["n_dropped"] == 2 and got[d]["text"] == text.split("\n")[2], d


def test_line_blocks_all_meet(spark):
    """In the turns of a round robin, every two blocks share a group once."""
    for blocks in (2, 4, 6, 10):
        met = []
        for k in range(blocks - 1):
            rows = spark.range(blocks).select(F.col("id").alias("block"), F.lit(blocks).cast("long").alias("blocks")).withColumn("group", line_dedup._facing(k)).collect()
            met += [(x["block"], y["block"]) for x in rows for y in rows if x["block"] < y["block"] and x["group"] == y["group"]]
        assert sorted(met) == [(x, y) for x in range(blocks) for y in range(x + 1, blocks)]


def test_long_lines_need_fewer_documents(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(n))
    two, three, short, copied = line(60), line(60), line(9), f"{line(60)}\n{line(9)}"
    rows = [(i, "\n".join([line(9), *([two] if i < 2 else []), *([three] if i < 3 else []), short, line(60)][: 5 if i < 3 else 1])) for i in range(6)]
    rows += [(10, copied), (11, copied)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(df).collect()}
    for d, text in rows:
        left = [x for x in text.split("\n") if x not in (two, three)]
        assert got[d]["text"] == "\n".join(left), d
    assert [line_dedup.needed(n, 8) for n in (4, 9, 27, 50, 500)] == [8, 8, 5, 2, 2]


def test_short_lines_need_more_documents(spark):
    """Lines under four tokens recur in 16 documents, and numbers alone only as they are."""
    rows = [(i, f"All rights reserved.\nPage {i}\n{1000 + i}\n77\n\n" + ("Read more\n" if i < 15 else "") + f"own{chr(97 + i)} text") for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(df).collect()}
    for d, text in rows:
        left = [x for x in text.split("\n") if x not in ("All rights reserved.", "77", f"Page {d}")]
        assert got[d]["text"] == "\n".join(left), d


def test_line_dedup_any_column(docs, rows, monkeypatch):
    """The caller's columns stay, the added ones give way, and both plans give the same."""
    monkeypatch.setattr(line_dedup, "MIN_DOCUMENTS", 2)
    got = []
    for bound in (2_000_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", bound)
        cleaned = line_dedup.clean_lines(docs, min_documents=2)
        assert cleaned.columns == [*docs.columns, "n_lines_", "n_dropped_"]
        got.append(sorted(map(tuple, cleaned.select("doc_id", "text", "n_lines", "drop", "_row", "n_lines_", "n_dropped_").collect())))
    texts = {d: t or "" for d, t, *_ in rows}
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all((n, d, r) == ("caller's n_lines", "caller's drop", "caller's _row") and k == texts[i].count("\n") + 1 for i, _, n, d, r, k, _ in got[0])
    assert sum(x[6] for x in got[0]) > 10


def test_line_dedup_long_text(spark):
    """Long texts of many lines, and of one line, are handled whole."""
    footer = "this is the footer of every page here"
    rows = [(i, "\n".join(f"w{i} x{k}a y{k} {'abcdefg'[k % 7]} own line of its own" for k in range(3000)) + f"\n{footer}") for i in range(9)]
    rows += [(20, "word " * 200_000), (21, None)]
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(footer not in got[i]["text"] and got[i]["n_lines"] == 3001 for i in range(9))
    assert got[20]["text"] == rows[9][1] and (got[21]["text"], got[21]["n_lines"], got[21]["n_dropped"]) == ("", 1, 0)


def test_lines_equal_plain_tree(spark):
    """Templates and counts against a plain restatement of the tree."""
    rng = random.Random(13)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(60)]
    common = [[rng.choice(words) for _ in range(rng.randint(3, 14))] for _ in range(25)]

    def line() -> str:
        tokens = list(rng.choice(common)) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            tokens[rng.randrange(len(tokens))] = rng.choice(["12", "a7", rng.choice(words)])
        return " ".join(tokens)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, None)]
    got = line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute.without_templates(rows, line_dedup.SIMILARITY, line_dedup.MIN_DOCUMENTS)
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want)
    assert sum(t != (x or "") for (_, t), (_, x) in zip(want, rows)) > 20


def test_line_dedup_empty(none):
    assert line_dedup.clean_lines(none).count() == 0


# --- mixing ----------------------------------------------------------------------------


def test_raking_meets_margins():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, k, 400) for k in (5, 3, 4)]
    shares = [np.array(s) for s in ([0.4, 0.3, 0.1, 0.1, 0.1], [0.5, 0.25, 0.25], [0.25] * 4)]
    w, worst = mixing.rake_local(codes, rng.integers(1, 1000, 400).astype(float), shares)
    for code, share in zip(codes, shares):
        assert np.allclose(np.bincount(code, w, len(share)), share, atol=1e-6)
    assert worst < 1e-6
    # two cells can't have these margins
    assert mixing.rake_local([np.array([0, 1]), np.array([0, 1])], np.ones(2), [np.array([0.9, 0.1]), np.array([0.1, 0.9])])[1] > 0.1


def test_frame_raking_equals_local(spark, docs, monkeypatch):
    slim, _ = mixing.measured(docs)
    cells = mixing.cells_of(slim).cache()
    monkeypatch.setattr(mixing, "SWEEPS", 4)
    key = lambda df: {tuple(r[m] for m in mixing.MARGINS): (r["w"], r["p"]) for r in df.collect()}
    local, worst = mixing.calibrated(cells)
    local = key(local)
    for values in (100_000, 0):
        monkeypatch.setattr(mixing, "LOCAL_VALUES", values)
        raked, far = mixing.rake_frame(cells, {m: mixing.targets(cells, m, None).cache() for m in mixing.MARGINS}, sweeps=4)
        total = raked.agg(F.sum("w")).first()[0]
        frame = key(mixing.scale_frame(raked.withColumn("w", F.col("w") / total), mixing.BUDGET))
        assert abs(far - worst) < 1e-6
        for k, (a, p) in local.items():
            assert abs(frame[k][0] - a) < 1e-6 and abs(frame[k][1] - p) < 1e-5


def test_mix_equals_plain(spark, docs, rows):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    draws = dict(docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id")).collect())
    want, residual = brute.mixed(rows, mixing)
    assert len({w[2] for w in want.values()}) > 5
    for d, (source, lang, topic, tokens, share, p) in want.items():
        r = got[d]
        assert (r["source"], r["lang"], r["topic"], r["tokens"]) == (source, lang, topic, tokens)
        assert abs(r["cell_share"] - share) < 1e-7 and abs(r["probability"] - p) < 1e-5
        if abs((draws[d] + 2.0**63) / 2.0**64 - p) > 1e-4:
            assert r["kept"] == ((draws[d] + 2.0**63) / 2.0**64 < p)
        assert abs(r["residual"] - residual) < 1e-7


def test_mix(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    expected = sum(r["tokens"] * r["probability"] for r in got)
    assert abs(expected / sum(r["tokens"] for r in got) - mixing.BUDGET) < 1e-3
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    only = mixing.mix(docs, given={"lang": {"en": 1.0}}, budget=0.2)
    assert {r["lang"] for r in only.filter("kept").collect()} == {"en"}


def test_mix_odd_rows(spark):
    """Null ids, texts and margins, repeated rows and long texts each keep a defined row."""
    rows = [(None, "a b", None, "x"), (None, "a b", None, "x"), (1, None, "en", None), (1, "", "en", None), (2, "long word " * 100_000, "en", "x"), (2, "long word " * 100_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(mixing.mix(df, budget=1.0).collect(), key=repr)
    assert len(got) == 6 and sorted(r["tokens"] for r in got) == [1, 1, 2, 2, 200_001, 200_001]
    assert {(r["source"], r["lang"]) for r in got} == {("x", ""), ("", "en"), ("x", "en")} and {r["topic"] for r in got} == {"other"}
    assert len({(r["doc_id"], r["kept"], r["probability"]) for r in got if r["doc_id"] != 1}) == 2


# --- toxicity --------------------------------------------------------------------------


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=n)
    z = 2 * x + rng.logistic(size=n)
    grade = np.digitize(z, [1.0, 2.0, 3.5])
    w, b, theta = toxicity.fit_ordinal(np.arange(n), np.zeros(n, np.int64), x, np.zeros(n), grade, 1, 3, l2=0.01)
    assert abs(w[0] - 2) < 0.25 and np.allclose(theta, [1.0, 2.0, 3.5], atol=0.3)


def test_a_bounded_sample_keeps_the_share_of_toxic_rows(spark, monkeypatch):
    """Where few of the other labels are used, documents are no likelier to be toxic."""
    rng = random.Random(3)
    rows = [(i, "vile thing" if rng.random() < (0.5 if i % 10 == 0 else 0.05) else f"plain thing {'abc'[i % 3]}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(4000)], "doc_id long, toxic int")
    shares = []
    for bound in (12_000, 400):
        monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", bound)
        shares.append(toxicity.score(df, toxicity.fit(df, labels)).agg(F.avg("p_toxic")).first()[0])
    assert all(abs(x - 0.1) < 0.02 for x in shares)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    model = toxicity.fit(docs, train)
    got = toxicity.score(docs, model).join(held, "doc_id").collect()
    right = sum(r["rejected"] == (r["toxic"] == 1) for r in got)
    assert len(got) > 80 and right / len(got) > 0.93
    assert all(abs(r["expected_severity"]) <= toxicity.GRADES for r in got)
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns


def test_scores_equal_plain(spark, docs, rows):
    """Scores recomputed from the model's numbers, and the likelihood's slope at the fit."""
    words = sorted({w for _, t, *_ in rows for w in (t or "").lower().split()})[:40]
    marked = {d: int(any(w in (t or "").lower().split() for w in words)) for d, t, *_ in rows}
    labels = spark.createDataFrame([*((d, m) for d, m in marked.items()), (None, 1), (next(iter(marked)), None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.features) > 5 and list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for d, text, *_ in rows:
        want = brute.severity(text, model)
        assert np.allclose([got[d]["p_toxic"], got[d]["expected_severity"]], want[:2]) and got[d]["rejected"] == (want[0] >= toxicity.REJECT)
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {d for d in marked if not got[d]["rejected"]}


def test_toxicity_odd_rows(spark):
    """Null ids, repeated rows and long texts keep their rows."""
    rows = [(i, "vile " * (i % 2) + f"plain words here {i}") for i in range(60)]
    odd = [(None, "vile words"), (None, None), (3, ""), (1, rows[1][1]), (1, rows[1][1]), (70, "fine " * 300_000 + "vile")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == 66 and sum(r["doc_id"] is None for r in got) == 2
    assert len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    assert toxicity.clean(df, model).count() == sum(not r["rejected"] for r in got)


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    model = toxicity.fit(docs, labels)
    assert not any(r["rejected"] for r in toxicity.score(docs, model).collect())
    assert toxicity.score(none, model).count() == 0 and toxicity.clean(docs, model).count() == docs.count()
