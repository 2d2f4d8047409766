"""Packing token sequences into fixed windows by minimum bin slack.

Each task tokenizes its documents and cuts whole windows off the front of long ones; those are sequences of their own.
What remains of each document (under one window) waits in a pool that keeps only counts by length and the pieces. When
the pool is full, windows are filled from it: the longest piece first, then a subset-sum over the multiset of remaining
lengths on bitsets (an int whose bit s says that a sum of s can be reached; the counts go in as 1, 2, 4, ... copies),
read at the reachable sum closest to capacity and traced back to counts by length. A pattern without slack is used again
while its lengths last, so many documents of one length cost one search. Where a window keeps some slack, every piece left
is longer than it (else the search had taken one more), so the longest is cut to fit and its rest goes back to the pool:
the slack found decides how many documents are cut. Only the last window of a task can stay short; it is cut at powers of
two, which are not padded. There is no shuffle, a pool has a fixed size, and a task that is run again gives the same rows.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """texts -> lists of ids, by the tokenizer of a file, which each worker process loads once.

    Two engines give the same ids: the file's own, and, for plain texts, tiktoken over ranks read from the file. The second
    is some three times as fast, and is used only if the file is byte-level BPE whose merges have rising ids (so a rank is
    an id), and only for texts of characters whose classes no version of Unicode disputes, that hold no special token.
    """
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        quick = _ranked(path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]

        def encode(texts: list[str]) -> list[list[int]]:
            plain = [quick is not None and len(t) < LONG and _PLAIN.fullmatch(t) is not None and not any(x in t for x in special) for t in texts]
            rest = iter(whole.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
            return [quick.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]

        _TOKENIZERS[path] = encode
    return _TOKENIZERS[path]


#: Texts from this many characters on always go by the tokenizer's own engine, whatever runs they hold.
LONG = 200_000
_PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u2030-\u203a]*")
# A fixed value: the pattern by which byte-level BPE cuts a text into words.
_WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(path: str):
    """tiktoken's encoding of a byte-level BPE file, or None if the file is of another kind."""
    import tiktoken

    spec = json.loads(Path(path).read_text())
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or model.get("dropout") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in pairs]
    if ids != sorted(set(ids)) or any(vocabulary[c] >= ids[0] for c in byte) or len(ids) + len(byte) != len({*ids, *(vocabulary[c] for c in byte)}):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and (len(token) == 1 or i >= ids[0])}
    for special in spec.get("added_tokens", []):
        ranks.pop(special["content"].encode(), None)
    return tiktoken.Encoding("file", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


def fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths, out of ``counts`` (length: pieces, none over capacity), that comes closest to ``capacity``
    and holds the longest length; and its sum."""
    lengths = sorted(counts, reverse=True)
    longest = lengths[0]
    room = capacity - longest
    mask, goal = (1 << room + 1) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable before)
    reach = 1
    for length in lengths:
        if length > room:
            continue
        left, copies = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach & goal:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach & goal:
            break
    at = total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    chosen[longest] += 1
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += copies
            at -= length * copies
    return dict(chosen), longest + total


class Pool:
    """Pieces that wait for a window, by length. ``full``: as many as make it worth filling windows."""

    def __init__(self, capacity: int, full: int):
        self.capacity, self.full, self.size = capacity, full, 0
        self.pieces: dict[int, deque] = {}

    def add(self, length: int, piece) -> None:
        self.pieces.setdefault(length, deque()).append(piece)
        self.size += 1

    def _take(self, length: int):
        piece = self.pieces[length].popleft()
        self.size -= 1
        if not self.pieces[length]:
            del self.pieces[length]
        return piece

    def windows(self, keep: int, cut) -> Iterator[list]:
        """Windows (lists of pieces) until ``keep`` pieces are left at most. ``cut`` takes a piece and a length, and gives its
        front of that length and its rest."""
        while self.size > keep:
            chosen, total = fill({k: len(v) for k, v in self.pieces.items()}, self.capacity)
            slack = self.capacity - total
            for _ in range(1 if slack else min(len(self.pieces[k]) // n for k, n in chosen.items())):
                if self.size <= keep:
                    break
                window = [self._take(k) for k, n in chosen.items() for _ in range(n)]
                if slack and self.size:
                    longest = max(self.pieces)
                    front, rest = cut(self._take(longest), slack)
                    window.append(front)
                    self.add(longest - slack, rest)
                yield window


def unpadded(length: int, capacity: int) -> list[int]:
    """The sizes of sequences without padding that ``length`` ids make: powers of two, unless they fill a window."""
    return [length] if length == capacity else [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, pool: int = 4096, batch: int = 64) -> DataFrame:
    """doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset: one row a piece.

    ``docs``: doc_id, text; other columns are ignored. A null or empty text is the end id alone. Each row of ``docs`` is
    packed by itself, so a row that repeats is packed twice, and a null doc_id is carried along. Texts are tokenized
    whole. An empty table gives no rows. sequence_id holds the task's number above 2**40 and a running number below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = tokenizer(tokenizer_path)
        waiting = Pool(capacity, pool)
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            columns = list(zip(*rows, strict=True))
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def put(doc: int, start: int, ids: np.ndarray, tokens: int, offset: int) -> None:
            nonlocal held
            rows.append((doc, start, len(ids), ids.tobytes(), tokens, number, offset))
            held += ids.nbytes

        def cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
            doc, start, ids, tokens = piece
            return (doc, start, ids[:length], tokens), (doc, start + length, ids[length:], tokens)

        def close(window: list) -> None:
            nonlocal number
            sizes = unpadded(sum(len(p[2]) for p in window), capacity)
            room, offset = sizes.pop(0), 0
            for piece in window:
                while len(piece[2]):
                    (doc, start, ids, tokens), piece = cut(piece, room - offset)
                    put(doc, start, ids, tokens, offset)
                    offset += len(ids)
                    if offset == room:
                        number, offset, room = number + 1, 0, sizes.pop(0) if sizes else 0

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for i in range(0, len(keys), batch):
                for doc, found in zip(keys[i : i + batch], encode(texts.slice(i, batch).to_pylist()), strict=True):
                    ids = np.array([*found, end_id], "<u4")
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        put(doc, start, ids[start : start + capacity], len(ids), 0)
                        number += 1
                    if whole < len(ids):
                        waiting.add(len(ids) - whole, (doc, whole, ids[whole:], len(ids)))
                if waiting.size >= waiting.full:
                    for window in waiting.windows(waiting.full // 2, cut):
                        close(window)
                if held > 4_000_000:
                    yield flush()
        for window in waiting.windows(0, cut):
            close(window)
            if held > 4_000_000:
                yield flush()
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, SCHEMA)
