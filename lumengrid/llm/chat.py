"""Chat formatting with a grammar round trip.

A turn is ``<turn ROLE>`` and a newline, the text, a newline, ``</turn>`` and a newline. The parser is deterministic: a role
runs to the first ``>`` without a backslash before it, a text to the first closing line, and a backslash takes the next
character as it is (none after it: an error). A turn is rendered as it stands, parsed again and compared with its source.
Where they differ, the conflicting content is escaped (backslashes and both control strings), and where that is not
enough, every ``<`` and ``>``. So plain texts stay as they are and the escapes are few.

Turns are rendered one by one; nothing needs a conversation as a whole but the reading back, which streams the rendered
turns of one conversation after another in sorted order and keeps two running digests, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "<turn ", "\n</turn>\n"
_ROLE = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
RENDERED = "conv_id long, turn long, rendered string, loss_start long, loss_end long"


def unescape(text: str) -> str:
    if (len(text) - len(text.rstrip("\\"))) % 2:
        raise ValueError("a single backslash ends the text")
    return _ESCAPED.sub(r"\1", text)


def parse(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn that starts at ``at``: role, text, where the text lies (start, end), where the turn ends."""
    head = _ROLE.match(rendered, at)
    end = rendered.find(TAIL, head.end()) if head else -1
    if end < 0:
        raise ValueError(f"no turn at {at}")
    return unescape(head[1]), unescape(rendered[head.end() : end]), head.end(), end, end + len(TAIL)


def parse_all(rendered: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(rendered):
        role, text, _, _, at = parse(rendered, at)
        turns.append((role, text))
    return turns


def _mild(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def _full(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text lies in it."""
    for escape in (lambda s: s, _mild, _full):
        r = escape(role)
        out = f"{HEAD}{r}>\n{escape(text)}{TAIL}"
        try:
            got = parse(out)
        except ValueError:
            continue
        if got[:2] == (role, text) and got[4] == len(out):
            return out, got[2], got[3]
    raise AssertionError("the full escape always parses back")


def format_turns(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, turn, rendered, loss_start, loss_end (code points in ``rendered``; equal where the turn is not learnt).

    One row for each row of ``conversations`` (conv_id, turn, role, text; other columns are ignored). A null role or text
    counts as empty. Rows keep null ids and turns. A conversation's text is its ``rendered`` by turn, then by ``rendered``
    (so ties and repeated rows have an order), null turns first. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out, start, end = render(role, text)
                rows.append((out, start, end if role == learn else start))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]], ["conv_id", "turn", "rendered", "loss_start", "loss_end"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text).mapInArrow(run, RENDERED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from the rendered text alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> pa.RecordBatch:
            n, turns, chars, loss, total = state
            values = [now[0], n, turns.hexdigest(), chars, loss.hexdigest(), total]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        done: list[pa.RecordBatch] = []
        for b in batches:
            for conv, rendered, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if now != (conv,):
                    if state:
                        done.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_all(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learnt = unescape(rendered[start:end])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(rendered)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state:
            yield row()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "rendered")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
