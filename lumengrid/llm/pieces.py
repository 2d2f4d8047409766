"""SentencePiece ids by a table of distinct chunks.

Where no piece of a model goes on from another character to a whitespace marker, a normalized text may be cut before every
run of markers: no merge crosses such a cut, so the ids of a text are those of its chunks (marked words), one after the
other. ``Segmenter.by_words`` reads from the model whether that holds; if not, a whole text is one chunk.

1. Blocks. Each task goes through its texts and numbers the distinct chunks it meets. A block ends at 262,144 distinct
   chunks or some millions of positions, and becomes rows of bytes: one with its documents as arrays of chunk numbers, and
   one for each bucket (a hash of the chunk) with its chunks of that bucket. Both are written, the first as a table bucketed by
   block, so that it is read once more without a shuffle.
2. Chunks. A bucket's chunks of all blocks meet in one task, which segments each distinct one once, and sends each block the
   ids of its chunks back, in the order they came.
3. Ids. A block's lists of ids, in order of the buckets, are the table that its documents' numbers point into, so a position
   gives its ids without any search.

Chunk rows grow with the distinct chunks of a block, not with its words, and each is in as many rows as there are blocks
at most, so frequent words make no hot key. A task holds one block, or one bucket's table, which starts anew when it
grows over a bound (chunks that come again are then segmented again, with the same ids).
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import shared_dir

MARK = "▁"
#: A block ends at this many distinct chunks or positions; a document is never split, so a long one may exceed both.
BLOCK_CHUNKS, BLOCK_POSITIONS = 1 << 18, 1 << 22
#: Chunks that a bucket's table holds before it starts anew.
TABLE_CHUNKS = 1 << 19
#: A block's documents (bucket null): their keys, numbers of positions, chunk numbers. Its chunks of a bucket: as JSON.
ROWS = "block long, bucket int, keys array<long>, sizes binary, data binary"
_MODELS: dict = {}


class Segmenter:
    """A model's file, loaded once in each worker process."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds, n = proto.ModelProto.SentencePiece, spec.normalizer_spec
        plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
        whole = [p.piece for p in spec.pieces if p.type not in (kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE)]
        own = any(p.type == kinds.USER_DEFINED for p in spec.pieces)
        #: Texts may be cut before markers: no normalization but that of blanks, no symbols that match first, no piece
        #: that goes on to a marker, and merges by rank (a unigram model weighs whole texts).
        self.by_words = bool(plain and not own and spec.trainer_spec.model_type == proto.TrainerSpec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{MARK}]{MARK}", p) for p in whole))

    def chunks(self, text: str) -> list[str]:
        """The chunks whose ids, one after the other, are the text's."""
        if not text:
            return []
        return _MARKED.findall(MARK + text.replace(" ", MARK)) if self.by_words else [text]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk. The model itself puts a marker in front of what it is given, so a chunk's first one is left
        out; but of nothing it makes no ids, so those of a lone marker (a text's last blank) are read off behind a letter."""
        if not self.by_words:
            return self.model.encode(chunks, num_threads=1)
        lone = self.model.encode("a ")[len(self.model.encode("a")) :]
        return [lone if c == MARK else i for c, i in zip(chunks, self.model.encode([c.removeprefix(MARK) for c in chunks], num_threads=1), strict=True)]


_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by planes of equal bytes."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_ROWS = [("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("sizes", pa.binary()), ("data", pa.binary())]


def _blocks(model: str, buckets: int, most_chunks: int, most_positions: int):
    """(key, text) -> ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = segmenter(model).chunks
        number: dict[str, int] = {}
        keys, docs, positions, block = [], [], 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            # in order of bucket and chunk: neighbours share prefixes and pieces, so chunks and ids compress well
            chunks = sorted((zlib.crc32(c.encode()) % buckets, c) for c in number)
            at = np.empty(len(chunks), np.uint32)
            at[np.fromiter((number[c] for _, c in chunks), np.int64, len(chunks))] = np.arange(len(chunks))
            cuts = np.searchsorted(np.fromiter((b for b, _ in chunks), np.int64, len(chunks)), np.arange(buckets + 1)).tolist()
            said = {b: json.dumps([c for _, c in chunks[i:z]], ensure_ascii=False) for b, (i, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < z}
            rows = [(block, b, None, None, zlib.compress(text.encode())) for b, text in said.items()]
            sizes = np.array([len(d) for d in docs])
            return _batch([*rows, (block, None, keys, packed(sizes), packed(at[np.concatenate(docs)]))], _ROWS)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chunks = cut(text.as_py())
                docs.append(np.fromiter((number.setdefault(c, len(number)) for c in chunks), np.uint32, len(chunks)))
                keys.append(key)
                positions += len(chunks)
                if len(number) >= most_chunks or positions >= most_positions or len(keys) >= most_positions:
                    yield close()
                    number, keys, docs, positions, block = {}, [], [], 0, block + 1
        if keys:
            yield close()

    return run


def _segmented(model: str, most: int):
    """Rows of chunks, one bucket after the other -> rows of the same block and bucket with the chunks' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = segmenter(model).ids
        held, known = None, {}
        for b in batches:
            for block, bucket, data in zip(*(b.column(i) for i in range(3)), strict=True):
                if bucket != held or len(known) > most:
                    held, known = bucket, {}
                chunks = json.loads(zlib.decompress(data.as_py()))
                new = [c for c in chunks if c not in known]
                known.update(zip(new, (np.array(i, "<u4") for i in encode(new)), strict=True))
                ids = [known[c] for c in chunks]
                yield _batch([(block.as_py(), bucket.as_py(), packed(np.array([len(i) for i in ids])), packed(np.concatenate(ids)))], [*_ROWS[:2], *_ROWS[3:]])

    return run


def _joined(key: str, most: int = 1 << 20):
    """Rows of a block's documents with its chunks' ids -> key, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, sizes, data, parts in zip(*(b.column(i) for i in range(4)), strict=True):
                table = sorted(parts.as_py() or [], key=lambda p: p["bucket"])
                length = np.concatenate([np.zeros(0, np.int64), *(unpacked(p["sizes"]) for p in table)]).astype(np.int64)
                flat = np.concatenate([np.zeros(0, np.uint32), *(unpacked(p["data"]) for p in table)]).astype(np.int32)
                start = np.cumsum(length) - length
                positions = unpacked(data.as_py())
                ends = np.cumsum(unpacked(sizes.as_py()).astype(np.int64))
                before = np.concatenate([[0], np.cumsum(length[positions])])[np.concatenate([[0], ends])]  # ids before each document
                i = 0
                while i < len(ends):
                    z = max(i + 1, int(np.searchsorted(before, before[i] + most, "right")) - 1)
                    own = positions[ends[i - 1] if i else 0 : ends[z - 1]]
                    n = length[own]
                    total = np.cumsum(n)
                    ids = flat[np.repeat(start[own] - (total - n), n) + np.arange(int(n.sum()))]
                    lists = pa.ListArray.from_arrays(pa.array((before[i : z + 1] - before[i]).astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([keys.values.slice(i, z - i), lists], [key, "ids"])
                    i = z

    return run


def segmenter(path: str) -> Segmenter:
    if path not in _MODELS:
        _MODELS[path] = Segmenter(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", block_chunks: int = BLOCK_CHUNKS, block_positions: int = BLOCK_POSITIONS) -> DataFrame:
    """``key`` (long), ids (array<int>): each row's whole text as the sentencepiece library encodes it with the file ``model``,
    without begin or end ids.

    A null or an empty text has no ids. Each row is encoded, so rows that repeat come out as often, and a null key is carried
    along. A text of any length is one row, also one without blanks (it is one chunk, then). An empty table gives no rows;
    other columns are ignored, whatever they are called.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(_blocks(model, buckets, block_chunks, block_positions), ROWS)
    name = f"pieces_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    cut = spark.table(name)
    chunks = cut.where("bucket IS NOT NULL").select("block", "bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    ids = chunks.mapInArrow(_segmented(model, TABLE_CHUNKS), "block long, bucket int, sizes binary, data binary")
    parts = ids.groupBy("block").agg(F.collect_list(F.struct("bucket", "sizes", "data")).alias("parts"))
    blocks = cut.where("bucket IS NULL").select("block", "keys", F.col("sizes").alias("doc_sizes"), F.col("data").alias("numbers"))
    # one row of each side for a block; the merge join keeps the table's buckets, so documents are not shuffled
    met = blocks.join(parts.hint("merge"), "block", "left").select("keys", "doc_sizes", "numbers", "parts")
    spark.sql(f"DROP TABLE {name}")  # the files stay, as those of every cut point
    return met.mapInArrow(_joined(key), f"{key} long, ids array<int>")


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """``key``, ids, text: the text that the library decodes from a row's ids. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = segmenter(model).model.decode
        for b in batches:
            texts = [back(i.values.to_numpy().tolist()) if i.is_valid and len(i) else "" for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [key, "ids", "text"])

    return encoded.select(F.col(key).cast("long"), "ids").mapInArrow(run, f"{key} long, ids array<int>, text string")
