"""Tokenisation with the tokenizers library, each distinct piece of a text encoded once.

Texts of plain Latin characters are split here, as the vocabulary file says, and
their pieces go to the library's model; that skips the library's text handling, four
fifths of the cost. All texts of a batch are split at once, by comparing neighbouring
bytes' classes, and the pieces are dictionary-encoded by Arrow; only those that a
Python worker hasn't met go to the model, and the ids of all are gathered from one
buffer. What is known is forgotten after CACHE_PARTS pieces or CACHE_IDS ids.

Other characters are left to the library: a text is cut before each space that a
non-space follows, and a part with such a character goes there whole. Both supported
ways of splitting have a boundary at a cut whatever stands around it, so encoding the
parts and joining gives the ids of the whole text. The two are in :data:`SPLITS` with
their whole settings; where the file says something else, whole texts go to the library.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Pieces known in a Python worker, about 310 bytes each, before they are forgotten.
CACHE_PARTS = 450_000
#: Their ids, as a part that goes to the library may be a whole text.
CACHE_IDS = 8_000_000
#: Ids in one array that a batch gives.
BATCH_IDS = 1 << 24
#: Characters that all versions of Unicode class and lower-case alike, each to one character.
_PLAIN = re.compile("[\t\n\r !-~¡-¬®-įı-ňŊ-ǯǱ-ȟ]*")

# The settings of the two ways to split text that are done here.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_BYTES = {"normalizer": None, "pre_tokenizer": _BYTE_LEVEL | {"use_regex": True}}
_WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _WORDS_PATTERN}, "behavior": "Removed", "invert": True},
            _BYTE_LEVEL | {"use_regex": False},
        ],
    },
}
#: Settings in a vocabulary file, the pattern of their pieces, and whether case is folded.
SPLITS = (
    (_BYTES, regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), False),
    (_WORDS, regex.compile(_WORDS_PATTERN), True),
)


def _byte_signs() -> list[str]:
    """The character that byte-level models use for each byte: itself if it is visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


# Classes of characters. Those from _ODD on aren't plain; _WHOLE stands for all bytes of a part that has one.
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD, _ODD_SPACE, _WHOLE = range(7)


def _class(c: str) -> int:
    if not _PLAIN.fullmatch(c):
        return _ODD_SPACE if c.isspace() else _ODD
    return next((k for k, p in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")) if regex.match(p, c)), _OTHER)


def _tables() -> tuple[np.ndarray, ...]:
    """Classes and lower case of single bytes and of pairs of bytes; no plain character has more than two bytes, in either case."""
    one, low = np.full(256, _ODD, np.uint8), np.arange(256, dtype=np.uint8)
    two, down = np.full(1 << 16, _ODD, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for c in map(chr, range(0x250)):
        raw, to = c.encode(), c.lower().encode() if _PLAIN.fullmatch(c) else c.encode()
        assert len(raw) == len(to)
        classes, lower = (one, low) if len(raw) == 1 else (two, down)
        classes[int.from_bytes(raw)], lower[int.from_bytes(raw)] = _class(c), int.from_bytes(to)
    return one, low, two, down


_CLASS, _LOWER, _CLASS2, _LOWER2 = _tables()
#: White space of three bytes.
_WIDE = np.array([c for c in range(0x800, 0x10000) if chr(c).isspace()])


def _starts_whole(raw: np.ndarray, classes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where parts begin that aren't plain; gives all their bytes the class _WHOLE."""
    after = np.append(raw[1:], np.zeros(3, np.uint8))
    spaced = np.append((classes[1:] == _SPACE) | (classes[1:] == _ODD_SPACE) | begin[1:], True)
    at = np.flatnonzero((raw == 0x20) & (after[: len(raw)] >= 0xE1) & (after[: len(raw)] <= 0xE3))
    a, b, c = (after[at + k].astype(np.int64) for k in range(3))
    spaced[at] |= np.isin((a & 15) << 12 | (b & 63) << 6 | c & 63, _WIDE)
    part = begin | ((raw == 0x20) & ~spaced)
    which = np.cumsum(part, dtype=np.int32)
    whole = np.zeros(which[-1] + 1, bool)
    whole[which[classes >= _ODD]] = True
    inside = whole[which]
    classes[inside] = _WHOLE
    return part & inside


def split(raw: np.ndarray, offsets: np.ndarray, folds: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of texts that stand one after another in ``raw``: their bytes, where each begins there, how many stand before each text.

    What the pattern in :data:`SPLITS` finds in a text, by rules on neighbours. With
    ``folds`` case is folded, a number is one character and white space is dropped;
    otherwise a run's last space, if something follows, belongs to what follows.
    """
    n = len(raw)
    begin = np.zeros(n, bool)
    begin[offsets[:-1][offsets[:-1] < n]] = True
    classes, text = _CLASS[raw], _LOWER[raw] if folds else raw
    at = np.flatnonzero(raw[:-1] >= 0xC2)
    pairs = raw[at].astype(np.uint16) << 8 | raw[at + 1]
    kinds = _CLASS2[pairs]
    classes[at] = kinds
    at, pairs, kinds = (x[kinds != _ODD] for x in (at, pairs, kinds))
    classes[at + 1] = kinds
    if folds:
        pairs = _LOWER2[pairs]
        text[at], text[at + 1] = pairs >> 8, pairs & 255
    starts = begin.copy()
    if (classes >= _ODD).any():
        starts |= _starts_whole(raw, classes, begin)
        text = np.where(classes == _WHOLE, raw, text)
    starts[1:] |= classes[1:] != classes[:-1]
    if folds:
        starts |= (classes == _NUMBER) & (raw & 0xC0 != 0x80)
    else:
        last = np.flatnonzero((classes[:-1] == _SPACE) & (classes[1:] != _SPACE) & (classes[1:] != _WHOLE) & ~begin[1:])
        starts[last] = True
        starts[last[raw[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll where a piece begins
    quote = np.flatnonzero((text[:-1] == 0x27) & starts[:-1] & (classes[:-1] == _OTHER) & (classes[1:] == _LETTER) & ~begin[1:])
    if len(quote):
        one, two = text[quote + 1], np.append(text, np.uint8(0))[quote + 2]
        two[np.append(begin, True)[quote + 2]] = 0
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        starts[ends[ends < n]] = True
    if not folds:
        starts = np.flatnonzero(starts)
        return text, starts, np.searchsorted(starts, offsets)
    kept = classes != _SPACE
    starts &= kept
    return text[kept], np.flatnonzero(starts[kept]), np.searchsorted(np.flatnonzero(starts), offsets)


class Encoder:
    """``encode_batch(texts)`` gives all ids and where each text's begin."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(made))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = {k: made.get(k) for k in ("normalizer", "pre_tokenizer")}
        model, extra = made["model"], ("dropout", "unk_token", "continuing_subword_prefix")
        special = all(t["special"] for t in made.get("added_tokens") or ())  # others are found in texts
        whole = special and made.get("post_processor") is None and model["type"] == "BPE" and not any(model.get(k) for k in extra)
        self.pattern, self.folds = next(((p, f) for s, p, f in SPLITS if whole and s == settings), (None, False))
        self.model, self.signs = self.tokenizer.model, "".join(_byte_signs())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a piece or whole part to its place
        self.ids, self.ends = array("I"), array("q", [0])

    def _place(self, piece: str) -> int:
        """Where the ids of a piece are, encoding it if it is new."""
        at = self.known.get(piece)
        if at is None:
            if self.pattern is not None and _PLAIN.fullmatch(piece):
                signs = piece if piece.isascii() and piece.isalnum() else charmap_decode(piece.encode(), "strict", self.signs)[0]
                self.ids.extend([t.id for t in self.model.tokenize(signs)])
            else:
                self.ids.extend(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            at = self.known[piece] = len(self.ends) - 1
            self.ends.append(len(self.ids))
        return at

    def encode_batch(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, and the offsets of each text's; null counts as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if not isinstance(texts, pa.Array) else texts, "")
        if len(self.ends) > CACHE_PARTS or len(self.ids) > CACHE_IDS:
            self._forget()
        if self.pattern is None:
            places, before = np.array([self._place(t) for t in texts.to_pylist()], np.int64), np.arange(len(texts) + 1)
        else:
            places, before = self._by_dictionary(texts.cast(pa.large_string()))
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        starts = ends[places]
        lengths = ends[places + 1] - starts
        after = np.append(0, np.cumsum(lengths))
        at = np.arange(after[-1]) + np.repeat(starts - after[:-1], lengths)
        return ids[at], after[before]

    def _by_dictionary(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each piece, and how many stand before each text."""
        _, offsets, raw = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if offsets[0] == offsets[-1]:
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        text, starts, before = split(np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], self.folds)
        bounds = pa.py_buffer(np.append(starts, len(text)))
        pieces = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(np.ascontiguousarray(text))).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        place = [self._place(n) if at is None else at for n, at in zip(names, map(self.known.get, names))]
        return np.array(place, np.int64)[pieces.indices.to_numpy()], before


def in_lists(ids: np.ndarray, offsets: np.ndarray) -> list[tuple[slice, pa.ListArray]]:
    """The ids as list arrays of at most BATCH_IDS ids (or one text's), each with the texts it is of."""
    out, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_IDS, side="right")) - 1)
        own = offsets[at : to + 1] - offsets[at]
        values = pa.array(ids[offsets[at] : offsets[to]].view(np.int32))
        out.append((slice(at, to), pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), values)))
        at = to
    return out


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    ends = offsets[1:]
    return np.insert(ids, ends, np.uint32(end_id)).astype("<u4", copy=False), offsets + np.arange(len(offsets))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the vocabulary file at ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
