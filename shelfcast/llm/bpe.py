"""Encode whole texts to token ids and decode them, with a compiled lexicon of frequent words.

The words of all documents are counted; the most frequent ones are compiled once
into a minimal acyclic transducer, a file of bounded size in the shared folder
that Spark hands to every executor, where tasks memory-map it. Words outside the
lexicon are merged exactly by the tokenizer's ranks. Both ways give the same ids,
so the lexicon only decides about speed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunks import PIECES, ChunkEncoder, is_plain, ragged
from .tables import Workspace, own_names, plain_names
from .transducer import Lexicon, Merger, byte_symbols, compile_lexicon
from .words import slices

# Words that are compiled, which bounds the file to a few MB.
LEXICON_WORDS = 1 << 16
# Longer words are never compiled.
LEXICON_BYTES = 64
# Distinct words a counting task holds before it hands its counts on.
COUNT_WORDS = 500_000


class WordSplitter:
    """Normalized words of a text: by Python's engine for plain texts, else by the library's."""

    def __init__(self, content: str):
        self.tokenizer = Tokenizer.from_str(content)
        added = {t["content"]: t["id"] for t in json.loads(content)["added_tokens"]}
        self.specials = added
        self.at_specials = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}

    def words(self, text: str) -> list[bytes | int]:
        """UTF-8 words in order, and ids where a special token stands."""
        if is_plain(text, self.specials):
            return [w.encode() for c in text.lower().split() for w in PIECES.findall(c)]
        out: list[bytes | int] = []
        for part in self.at_specials.split(text) if self.at_specials else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    out.append(bytes(self.byte_of[c] for c in piece))
        return out


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, content: str, lexicon: str):
        self.splitter = WordSplitter(content)
        model = json.loads(content)["model"]
        self.merger = Merger(model)
        self.lexicon = Lexicon(lexicon)
        self.token = [""] * self.splitter.tokenizer.get_vocab_size(True)
        for name, i in {**model["vocab"], **self.splitter.specials}.items():
            self.token[i] = name
        self.encoder = ChunkEncoder(self._chunks, self._other, tuple(self.splitter.specials))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        distinct = list(dict.fromkeys(words))
        place = dict(zip(distinct, range(len(distinct))))
        rows = self.lexicon.rows(distinct)
        known = np.flatnonzero(rows >= 0)
        unseen = np.flatnonzero(rows < 0)
        ids, sizes = self.lexicon.ids_of(rows[known])
        more, more_sizes = self.merger.merge([distinct[k] for k in unseen])
        lengths = np.zeros(len(distinct), np.int64)
        lengths[known], lengths[unseen] = sizes, more_sizes
        starts = np.zeros(len(distinct), np.int64)
        starts[known] = np.cumsum(sizes) - sizes
        starts[unseen] = len(ids) + np.cumsum(more_sizes) - more_sizes
        pool = np.concatenate([ids, more])
        code = np.fromiter((place[w] for w in words), np.int64, len(words))
        return pool[ragged(starts[code], lengths[code])], lengths[code]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        counts = np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            parts = PIECES.findall(chunk)
            counts[k] = len(parts)
            words.extend(w.encode() for w in parts)
        ids, lengths = self._words(words)
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]
        return ids, np.diff(np.r_[0, ends])

    def _other(self, text: str) -> np.ndarray:
        parts = self.splitter.words(text)
        words = [w for w in parts if isinstance(w, bytes)]
        ids, lengths = self._words(words)
        pieces = iter(np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else [])
        out = [next(pieces) if isinstance(w, bytes) else np.array([w], np.uint32) for w in parts]
        return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between two, as the library does without a decoder."""
        return " ".join([self.token[i] for i in ids.tolist()])


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(content: str, lexicon: str) -> Codec:
    """The codec of this Python worker, which keeps its chunks from task to task."""
    key = (content, lexicon)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content, SparkFiles.get(lexicon))
    return _codecs[key]


def count_words(docs: DataFrame, text_col: str, content: str) -> DataFrame:
    """(word, occurrences) over all documents; tasks add up what they see before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = WordSplitter(shared.value)
        chunks: Counter = Counter()
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            for chunk, n in chunks.items():
                for w in PIECES.findall(chunk):
                    words[w.encode()] += n
            kept = [w for w in words if len(w) <= LEXICON_BYTES]
            rows = pa.record_batch(
                [pa.array(kept, pa.binary()), pa.array([words[w] for w in kept], pa.int64())], ["word", "n"]
            )
            chunks.clear()
            words.clear()
            return rows

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                if is_plain(text, splitter.specials):
                    chunks.update(text.lower().split())
                else:
                    words.update(w for w in splitter.words(text) if isinstance(w, bytes))
                if len(chunks) + len(words) > COUNT_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(
    docs: DataFrame, text_col: str, content: str, workspace: Workspace, most: int = LEXICON_WORDS
) -> str:
    """Compile the most frequent words, ``most`` at most, and add the file to the application.

    Counts are taken from the highest down while their words fit as a whole, so
    only the words chosen reach the driver. Returns the name under which tasks
    find the file.
    """
    spark = docs.sparkSession
    counts = workspace.write(count_words(docs, text_col, content), "counts")
    # One row per distinct count.
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = levels.withColumn("so_far", F.sum("words").over(down)).where(F.col("so_far") <= most).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= least).select("word").collect() if least is not None else []
    workspace.drop(counts)
    words = sorted(bytes(r.word) for r in top)
    ids, lengths = Merger(json.loads(content)["model"]).merge(words)
    packed = compile_lexicon(words, ids, lengths)
    name = f"lexicon-{hashlib.sha256(packed).hexdigest()[:24]}.bin"
    _add_file(spark, workspace, name, packed)
    return name


def _add_file(spark: SparkSession, workspace: Workspace, name: str, content: bytes) -> None:
    """Write ``content`` to the shared folder and let Spark hand it to every executor."""
    context = spark.sparkContext
    added = getattr(context, "_shelfcast_files", set())
    if name in added:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(f"{workspace.root}/{name}")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(content))
    stream.close()
    context.addFile(f"{workspace.root}/{name}")
    context._shelfcast_files = added | {name}


def encode_decode(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    decode: bool = True,
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """``docs`` without the text, plus token_ids (packed little-endian 32-bit ids) and decoded.

    Equal to the tokenizers library's encode without special tokens around a text
    and its decode with special tokens kept. Null text: as the empty text, no
    ids and the empty string. Special tokens inside a text become their ids.
    Every other column passes through, but for earlier ones of the two names.
    ``decode=False`` leaves decoded out.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "bpe")
    content = Path(tokenizer_path).read_text(encoding="utf-8")
    lexicon = build_lexicon(docs, text_col, content, workspace, lexicon_words)
    shared = spark.sparkContext.broadcast(content)
    docs, own = plain_names(docs, ("token_ids", "decoded"))
    text = own.pop(text_col)
    kept = list(own.values())
    schema = docs.select(*kept).schema.add("token_ids", "binary")
    if decode:
        schema = schema.add("decoded", "string")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, lexicon)
        for batch in batches:
            texts = batch.column(len(kept))
            for begin, end in slices(texts):
                part = [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
                ids, bounds = codec.encoder.encode(part)
                rows = [ids[bounds[k] : bounds[k + 1]] for k in range(len(part))]
                columns = [batch.column(k).slice(begin, end - begin) for k in range(len(kept))]
                columns.append(pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()))
                if decode:
                    columns.append(pa.array([codec.decode(r) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(*kept, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return rows.select(*own_names(own), *names[len(kept) :])
