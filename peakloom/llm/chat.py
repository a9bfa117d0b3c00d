"""Chat formatting with a grammar round trip.

    conversation = turn*
    turn         = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Each rendered turn is parsed again; where the parser does not recover the very
role and text, the content is escaped and tried again. A control string is
escaped by a backslash after its "<|", one more for each level, and the parser
takes one away, so every text has one form and comes back whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, text_of

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")


def escape(text: str) -> str:
    """One level of escape on every control string, escaped or not."""
    return _CONTROL.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns (role, text, text start, text end) of a rendered conversation; ValueError if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.find("\n", at)
        end = formatted.find(END, line + 1) if line >= 0 else -1
        if end < 0 or not formatted.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} does not end")
        role, text = formatted[at + len(START) : line], formatted[line + 1 : end]
        if START in role or END in role or START in text:
            raise ValueError(f"a control string inside the turn at {at}")
        turns.append((_unescape_role(role), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped only as far as the parser needs to recover it."""
    for r, t in ((role, text), (role, escape(text)), (_escape_role(role), escape(text))):
        formatted = f"{START}{r}\n{t}{END}\n"
        try:
            got = parse(formatted)
        except ValueError:
            continue
        if len(got) == 1 and got[0][:2] == (role, text):
            return formatted
    raise ValueError("the turn can't be rendered")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, segment, and the part under the loss mask.

    A conversation is its segments in order of turn (then segment, for repeated
    turns). ``loss_from`` and ``loss_to`` are code points in the segment, null
    for roles without loss. Null role or text counts as empty; null turns come
    first; other columns are ignored.
    """
    small_batches(turns.sparkSession, 4096)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, begins, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                segment = render(role, text)
                (_, _, begin, end), loss = parse(segment)[0], role == LOSS_ROLE
                segments.append(segment)
                begins.append(begin if loss else None)
                ends.append(end if loss else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(segments, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "turn", "segment", "loss_from", "loss_to"],
            )

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, "conv_id long, turn long, segment string, loss_from long, loss_to long")


def read_back(segments: DataFrame) -> DataFrame:
    """A row per conversation, parsed from its segments as they stream by in order.

    Running digests make the memory of a conversation of any length that of a turn.
    """
    small_batches(segments.sparkSession, 4096)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

        def closed() -> tuple:
            n, turns, chars, loss, length = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), length

        for batch in batches:
            rows = []
            for conv, segment, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to"))):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if begin is not None:
                    masked = unescape(segment[begin:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            yield made(rows)
        if state is not None:
            yield made([closed()])

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return dealt.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
