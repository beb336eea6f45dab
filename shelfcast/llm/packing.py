"""Token ids as files of fixed-width bits, in document order, with random access.

A file set is a Parquet table in the shared folder, written by Spark's own commit
protocol, so a lost executor leaves no half file. A row is a chunk of whole
documents: their ids, the first id of each, and the ids packed in the fewest bits
the vocabulary needs. Packed ids come in blocks of ``BLOCK_IDS``; each block
begins on a byte given in the chunk's block offsets, so any id or document is
read by unpacking only its blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .chunks import PIECES, ChunkEncoder
from .tables import Workspace
from .transducer import byte_symbols
from .words import slices

# Ids of a block, a multiple of 8.
BLOCK_IDS = 4096
# A chunk ends with the document that brings it to this many ids.
CHUNK_IDS = 1 << 18


def bit_width(vocabulary: int) -> int:
    """Fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first, filled up to eight ids."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(data: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.zeros((len(rows), 8), np.uint32)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(len(rows), np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= rows[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


def pack_blocks(ids: np.ndarray, bits: int) -> tuple[bytes, np.ndarray]:
    """All blocks, one after the other, and the byte at which each begins (and the end)."""
    parts = [pack(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    return b"".join(parts), np.cumsum([0, *map(len, parts)])


def unpack_range(payload, offsets: np.ndarray, n_ids: int, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a chunk, from the blocks that hold them."""
    if begin >= end:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(payload, np.uint8)
    first, last = begin // BLOCK_IDS, (end - 1) // BLOCK_IDS
    parts = [
        unpack(data[offsets[b] : offsets[b + 1]], min(BLOCK_IDS, n_ids - b * BLOCK_IDS), bits)
        for b in range(first, last + 1)
    ]
    return np.concatenate(parts)[begin - first * BLOCK_IDS : end - first * BLOCK_IDS]


class LibraryEncoder(ChunkEncoder):
    """Whole texts as the tokenizers library encodes them, each distinct word by the library's model once."""

    def __init__(self, content: str):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        added = [t["content"] for t in json.loads(content)["added_tokens"]]
        super().__init__(self._chunks, self._other, tuple(added))

    def _other(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [PIECES.findall(chunk) for chunk in chunks]
        ids_of = {
            word: [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))]
            for word in {word for words in split for word in words}
        }
        rows = [[i for word in words for i in ids_of[word]] for words in split]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(content: str) -> LibraryEncoder:
    """The encoder of this Python worker, which keeps its chunks from task to task."""
    if content not in _encoders:
        _encoders.clear()
        _encoders[content] = LibraryEncoder(content)
    return _encoders[content]


@dataclass
class TokenFiles:
    """A written file set: its folder, the bits of an id, and the ids before each shard."""

    path: str
    bits: int
    chunks: DataFrame
    shards: DataFrame


CHUNK_FIELDS = [
    ("shard", T.IntegerType()),
    ("chunk", T.IntegerType()),
    ("first", T.LongType()),
    ("n_ids", T.LongType()),
    ("bits", T.IntegerType()),
    ("doc_ids", None),
    ("doc_starts", T.BinaryType()),
    ("block_offsets", T.BinaryType()),
    ("payload", T.BinaryType()),
]


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> TokenFiles:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending id order.

    Null text: the empty text. Null ids come first. Rows of one id follow each
    other by a hash of their text; equal rows are interchangeable. Sorted by
    ranges of (id, hash), so a hot id spreads over tasks. An empty table gives an
    empty file set.
    """
    spark = docs.sparkSession
    content = Path(tokenizer_path).read_text(encoding="utf-8")
    vocabulary = Tokenizer.from_str(content).get_vocab_size(True)
    bits = bit_width(max(vocabulary, (end_id or 0) + 1))
    shared = spark.sparkContext.broadcast(content)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(n, T.ArrayType(id_type) if t is None else t) for n, t in CHUNK_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(shared.value)
        shard = TaskContext.get().partitionId()
        first, number = 0, 0
        held_ids: list[np.ndarray] = []
        held_docs: list = []
        held_sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal first, number
            ids = np.concatenate(held_ids)
            payload, offsets = pack_blocks(ids, bits)
            starts = np.r_[0, np.cumsum(np.concatenate(held_sizes))].astype("<i8")
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([bits], pa.int32()),
                    pa.array([held_docs], pa.list_(id_arrow)),
                    pa.array([starts.tobytes()], pa.binary()),
                    pa.array([offsets.astype("<i8").tobytes()], pa.binary()),
                    pa.array([payload], pa.binary()),
                ],
                [n for n, _ in CHUNK_FIELDS],
            )
            first += len(ids)
            number += 1
            held_ids.clear()
            held_docs.clear()
            held_sizes.clear()
            return row

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for begin, end in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(begin, end - begin).to_pylist()]
                ids, bounds = encoder.encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                held_ids.append(ids)
                held_docs.extend(batch.column(0).slice(begin, end - begin).to_pylist())
                held_sizes.append(np.diff(bounds))
                if sum(map(len, held_ids)) >= CHUNK_IDS:
                    yield flush()
        if held_docs:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .withColumn("_tie", F.xxhash64("_text"))
        .repartitionByRange(F.col("_id").asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col("_id").asc_nulls_first(), "_tie")
        .select("_id", "_text")
    )
    workspace = Workspace(spark, "tokens")
    if path:
        workspace.root = path
    chunks = workspace.write(ordered.mapInArrow(run, schema), "files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    return TokenFiles(workspace.root, bits, chunks, workspace.write(shards, "shards"))


def read_token_files(files: TokenFiles, id_col: str = "doc_id") -> DataFrame:
    """A row per document: id, start (ids of all documents before it) and token_ids (packed 32-bit)."""
    id_type = files.chunks.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    )
    bits = files.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_arrow = batch.column("doc_ids").type.value_type
            for k in range(batch.num_rows):
                starts = np.frombuffer(batch.column("doc_starts")[k].as_buffer(), "<i8")
                offsets = np.frombuffer(batch.column("block_offsets")[k].as_buffer(), "<i8")
                payload = batch.column("payload")[k].as_buffer()
                n_ids = batch.column("n_ids")[k].as_py()
                ids = unpack_range(payload, offsets, n_ids, bits, 0, n_ids).astype("<u4")
                base = batch.column("before")[k].as_py() + batch.column("first")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("doc_ids")[k].as_py(), id_arrow),
                        pa.array(base + starts[:-1], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                    ],
                    schema.fieldNames(),
                )

    chunks = files.chunks.select("shard", "first", "n_ids", "doc_ids", "doc_starts", "block_offsets", "payload")
    return chunks.join(files.shards, "shard").drop("shard").mapInArrow(run, schema)
