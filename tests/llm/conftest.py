"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 160, seed: int = 3) -> list[tuple]:
    """Random prose with copies, near copies, null, empty, tiny and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts: list[str | None] = [None, "", " \n\t ", "one two", "one two", "one  two three four", "Zoë 😀 naïve\r\nx", "a" * 3000, "word " * 2500]
    while len(texts) < n:
        roll = rng.random()
        if roll < 0.15:
            texts.append(rng.choice(texts[3:]))
        elif roll < 0.5 and len(texts) > 12:
            words = rng.choice(texts[9:]).split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
            at = rng.randrange(len(words))
            middle = [passage] if rng.random() < 0.3 else []
            texts.append(" ".join([*words[:at], *middle, *words[at:]]))
    ids = rng.sample(range(10 * n), n)
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t or "")) for d, t in zip(ids, texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


#: Names that operators use for columns of their own, and some of their results.
HELPERS = """
    a added agree allowed another at b base best bitmap blob block blocks bucket c cell cells chars chunk clean comp component conv_id context copy
    count cut docs doc drop edge expected_severity feature file fingerprint form found grade group hashes hi home ids ids_crc32 item keep_id kept key
    kind known label leaf least length line lines lo lost m members n n_dropped n_lines n_tokens need needs next_text no node odds offset one other
    owner owners p parts partner piece places probing rank rejected rep row rows score segment sequence_id share shares size sizes start stored
    template text_sha256 texts threshold token tokens top topic total toxic trust turn w words x y z
    _ _after _all _at _bin _bitmap _bucket _cell _count _drop _first _ghost _gone _h _id _in _k _keep _key _lines _m _maybe _mix_ _mix_all _mix_cell
    _mix_draw _mix_lang _mix_p _mix_source _mix_tokens _mix_topic _mix_w _n _next _now _own _own_ _part _raw _rank _row _same _seed _sha _size _text
    _that _tokens _total _tox_ _tox_grade _tox_rejected _tox_score _wraps _x
""".split()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus, with columns whose names any operator might use for itself."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit(f"caller's {c}") for c in HELPERS}).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
