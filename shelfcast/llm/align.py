"""Which tokens of two tokenizers cover the same bytes, and how often two ids meet in a corpus.

Both tokenizers cut every text independently at a single space or line end between
two characters that are not white space, so a text is aligned chunk by chunk and a
task aligns each distinct chunk once. Inside a chunk the spans that the libraries
report (character offsets of one, byte spans of the other) are the coarse cuts.
Where they are not exact - tokens that share a character of several bytes, pieces
of a byte fallback - the lengths of the decoded tokens refine them. The bytes of
all tokens of a text must give the text again; else it has no tokens.

A shard is a bounded number of documents of a task. It is written once, as its
documents' chunk numbers and the links of its distinct chunks; from these
tables come the counts of all linked ids and then, with the counts, the documents' figures.
The counted pairs go to the tasks in parts of four million, with one pass over the
shards for each; corpora of most kinds need one.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import small_batches
from .chunks import ragged
from .tables import Workspace, plain_names
from .transducer import byte_symbols
from .words import slices

# A first character with the white space behind it, then everything up to a single space
# or line end between two other characters.
CHUNK = re.compile(r"[\s\S]\s*\S*(?:(?![ \n]\S)\s+\S*)*")
# Bytes of distinct chunks (with what a chunk costs besides) after which a worker forgets those it has aligned.
MOST_CHUNK_BYTES, CHUNK_COST = 64 << 20, 200
# Pairs of ids that travel to the tasks at a time.
PART_PAIRS = 1 << 22
# Bytes of texts of a shard, and distinct pairs a task holds.
SHARD_BYTES, MOST_PAIRS = 2 << 20, 1 << 18
# Shards of a file, some 5 MB each: all that a task writes or reads at a time, however many it has.
FILE_SHARDS = 4
# Chunks that are encoded as one text, and at a time.
BLOCK_CHUNKS, LEARN_CHUNKS = 256, 1 << 13

SPACE = "▁"
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
ADDED = (*FIGURES, "n_best", "count_sum", "groups")


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and begin of each entry, and all their bytes."""
    lengths = np.array([len(x) for x in entries])
    return lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(entries), np.uint8)


class Aligner:
    """Aligns chunks; built from the contents of both tokenizer files."""

    def __init__(self, word_json: bytes, piece_model: bytes):
        self.a = Tokenizer.from_buffer(word_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        symbols = {c: b for b, c in enumerate(byte_symbols())}
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        self.bytes_a = [bytes(symbols[c] for c in e) if all(c in symbols for c in e) else e.encode() for e in entries]
        self.n_b = self.b.get_piece_size()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode()
            for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.n_b))
        ]
        self.is_byte = np.array([self.b.is_byte(k) for k in range(self.n_b)])
        # Chunks are independent if no piece holds a space mark behind another character, or a line end.
        for k in range(self.n_b):
            piece = self.b.id_to_piece(k)
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError("pieces that reach over white space cannot be aligned chunk by chunk")
        self.length_a, self.start_a, self.content_a = _flat(self.bytes_a)
        self.length_b, self.start_b, self.content_b = _flat(self.bytes_b)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids and byte ends (in all texts) of the tokens of both tokenizers, byte bounds of the texts, and which are whole.

        Texts begin with a space or a line end. Those that are not whole have no tokens.
        """
        contents = [t.encode() for t in texts]
        content = np.frombuffer(b"".join(contents), np.uint8)
        bounds = np.r_[0, np.cumsum([len(c) for c in contents])].astype(np.int64)
        encoded = [self.a.encode(t, add_special_tokens=False) for t in texts]
        count_a = np.array([len(e) for e in encoded])
        flat = itertools.chain.from_iterable
        id_a = np.fromiter(flat(e.ids for e in encoded), np.int64, count_a.sum())
        spans = np.fromiter(flat(flat(e.offsets for e in encoded)), np.int64, 2 * len(id_a)).reshape(-1, 2)
        end_a, whole_a = self._ends_a(id_a, spans, count_a, content, bounds)

        # The library puts a space mark in front. It stands for the space a text begins with; in front of a
        # line end it is a token of its own, which the text has not.
        protos = self.b.encode([t[1:] if t[0] == " " else t for t in texts], return_type="proto", num_threads=1)
        count_b = np.array([len(p.pieces) for p in protos])
        fields = np.fromiter(flat((x.id, x.end) for p in protos for x in p.pieces), np.int64, 2 * count_b.sum()).reshape(-1, 2)
        marked = np.array([t[0] == " " for t in texts], bool)
        first = np.cumsum(count_b) - count_b
        alone = np.zeros(len(fields), bool)
        alone[first[(count_b > 0) & ~marked]] = True
        id_b, reported = fields[~alone, 0], fields[~alone, 1]
        count_b = count_b - ((count_b > 0) & ~marked)
        end_b, whole_b = self._ends_b(id_b, reported + np.repeat(marked, count_b), count_b, content, bounds)
        whole = whole_a & whole_b
        keep_a, keep_b = np.repeat(whole, count_a), np.repeat(whole, count_b)
        return id_a[keep_a], end_a[keep_a], id_b[keep_b], end_b[keep_b], bounds, whole

    def _ends_a(self, ids, spans, counts, content, bounds):
        """Byte ends from character offsets; tokens that share a character end where their decoded bytes do."""
        char = np.flatnonzero(np.r_[content & 0xC0 != 0x80, True])
        base = np.repeat(np.searchsorted(char, bounds[:-1]), counts)
        coarse = char[base + spans[:, 1]]
        decoded = self._decoded_ends(self.length_a[ids], counts, bounds)
        last = np.zeros(len(ids), bool)
        last[(np.cumsum(counts) - 1)[counts > 0]] = True
        shared = np.zeros(len(ids), bool)
        shared[:-1] = ~last[:-1] & (spans[1:, 0] < spans[:-1, 1])
        ends = np.where(shared, decoded, coarse)
        joined = self.content_a[ragged(self.start_a[ids], self.length_a[ids])]
        return ends, self._whole(ends, decoded, counts, content, bounds, joined, self.length_a[ids])

    def _ends_b(self, ids, reported, counts, content, bounds):
        """Byte ends from reported spans; pieces of single bytes end where their decoded bytes do."""
        decoded = self._decoded_ends(self.length_b[ids], counts, bounds)
        ends = np.where(self.is_byte[ids], decoded, reported + np.repeat(bounds[:-1], counts))
        joined = self.content_b[ragged(self.start_b[ids], self.length_b[ids])]
        return ends, self._whole(ends, decoded, counts, content, bounds, joined, self.length_b[ids])

    @staticmethod
    def _decoded_ends(lengths, counts, bounds):
        total = np.cumsum(lengths)
        begin = np.r_[0, total][np.cumsum(counts) - counts]
        return total + np.repeat(bounds[:-1] - begin, counts)

    @staticmethod
    def _whole(ends, decoded, counts, content, bounds, joined, token_lengths):
        """Texts whose tokens' bytes (``joined``) are the text's bytes and end where their spans say."""
        sizes = np.diff(bounds)
        tokens = np.r_[0, np.cumsum(counts)]
        lengths = np.r_[0, np.cumsum(token_lengths)][tokens]
        right = np.diff(lengths) == sizes
        wrong = np.r_[0, np.cumsum(ends != decoded)]
        right &= wrong[tokens[1:]] == wrong[tokens[:-1]]
        rows = np.flatnonzero(right)
        here, there = ragged(bounds[rows], sizes[rows]), ragged(lengths[rows], sizes[rows])
        differ = np.r_[0, np.cumsum(content[here] != joined[there])]
        last = np.cumsum(sizes[rows])
        right[rows] = differ[last] == differ[last - sizes[rows]]
        return right


def _blocks(chunks: list[str]) -> list[list[str]]:
    """Chunks that may stand one behind the other in a text, some in a block; others are blocks of their own."""
    alone = [c for c in chunks if c[-1].isspace() or c[1:2].isspace()]
    loose = set(alone)
    joined = [c for c in chunks if c not in loose]
    return [[c] for c in alone] + [joined[k : k + BLOCK_CHUNKS] for k in range(0, len(joined), BLOCK_CHUNKS)]


class Chunks:
    """Distinct chunks a worker has aligned, as flat arrays by chunk number."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.bytes = 0
        self.whole = np.zeros(0, bool)
        self.figures = np.zeros((0, 4), np.int32)
        self.links = np.zeros(0, np.uint32)
        self.ends = np.zeros(0, np.uint8)
        self.link_bounds = np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        blocks = _blocks(new)
        *_, whole = found = self.aligner.tokens(["".join(b) for b in blocks])
        # A block with a chunk that its tokens do not give again is taken apart.
        rest = [[c] for b, w in zip(blocks, whole) if not w for c in b]
        self._keep([b if w else [] for b, w in zip(blocks, whole)], *found[:4], found[4], np.ones(len(blocks), bool))
        if rest:
            found = self.aligner.tokens([b[0] for b in rest])
            self._keep(rest, *found)

    def _keep(self, blocks, id_a, end_a, id_b, end_b, block_bounds, whole) -> None:
        """Note the chunks of ``blocks`` (an empty one has no tokens) with the tokens found in them."""
        names = list(itertools.chain.from_iterable(blocks))
        if not names:
            return
        sizes = np.array([len(c.encode()) for c in names], np.int64)
        counts = np.array([len(b) for b in blocks])
        run = np.cumsum(sizes) - sizes
        first = np.cumsum(counts) - counts
        base = block_bounds[:-1][counts > 0] - run[first[counts > 0]]
        begin = run + np.repeat(base, counts[counts > 0])
        end = begin + sizes
        for name in names:
            self.index[name] = len(self.index)
        self.bytes += int(sizes.sum()) + CHUNK_COST * len(names)
        # Where a token of either ends, one token of each has covered the bytes since the end before.
        ends = _merged(end_a, end_b)
        place_a, place_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = id_a[place_a] * self.aligner.n_b + id_b[place_b]
        # Which of both tokens of a link end with it: 1, 2 or 3 for both.
        which = (end_a[place_a] == ends) | (end_b[place_b] == ends).astype(np.uint8) << 1
        cuts = ends[which == 3]

        def per_chunk(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(at, end, "right") - np.searchsorted(at, begin, "right")

        of_links = per_chunk(ends)
        figures = np.stack([per_chunk(end_a), per_chunk(end_b), per_chunk(cuts), of_links], 1)
        self.whole = np.concatenate([self.whole, whole[np.repeat(np.arange(len(blocks)), counts)]])
        self.figures = np.concatenate([self.figures, figures.astype(np.int32)])
        self.links = np.concatenate([self.links, links.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, which.astype(np.uint8)])
        self.link_bounds = np.concatenate([self.link_bounds, self.link_bounds[-1] + np.cumsum(of_links)])

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts and each text's number of chunks."""
        if self.bytes > MOST_CHUNK_BYTES:
            self.reset()
        parts = [CHUNK.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        flat = list(itertools.chain.from_iterable(parts))
        new = list(set(flat).difference(self.index))
        for k in range(0, len(new), LEARN_CHUNKS):
            self.learn(new[k : k + LEARN_CHUNKS])
        return np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat)), counts


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distinct values of two sorted arrays, sorted."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both


_aligner = lru_cache(maxsize=1)(Aligner)


@lru_cache(maxsize=1)
def _chunks(key: str, files: Broadcast) -> Chunks:
    """The worker's chunks of the run with this key, kept from task to task."""
    return Chunks(_aligner(*files.value))


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


_SHARD = "counts binary, codes binary, lengths binary, links binary, ends binary, best binary, sums binary"


def _aligned(key: str, files: Broadcast, kept: list[str]):
    """A row for each shard: its documents with their numbers of tokens, groups and links, their chunks, and each distinct chunk's links."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(key, files)
        for batch in batches:
            for a, b in slices(batch.column("text"), SHARD_BYTES):
                part = batch.slice(a, b - a)
                codes, counts = chunks.codes(part.column("text").to_pylist())
                used, codes = np.unique(codes, return_inverse=True)
                run = np.r_[0, np.cumsum(counts)]
                broken = np.r_[0, np.cumsum(~chunks.whole[used[codes]])][run]
                valid = (counts > 0) & (broken[1:] == broken[:-1])
                codes, counts = codes[np.repeat(valid, counts)], np.where(valid, counts, 0)
                run = np.r_[0, np.cumsum(counts)]
                total = np.zeros((len(codes) + 1, 4), np.int64)
                np.cumsum(chunks.figures[used[codes]], 0, np.int64, total[1:])
                sums = np.diff(total[run], axis=0)
                columns = [part.column(c) for c in kept] + [pa.array(sums[:, k]) for k in range(4)]
                docs = pa.StructArray.from_arrays(columns, [*kept, *FIGURES])
                lengths = np.diff(chunks.link_bounds)[used]
                places = ragged(chunks.link_bounds[used], lengths)
                nothing = np.zeros(len(docs), np.int64)
                yield pa.record_batch(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                        _binary(counts.astype(np.int32)),
                        _binary(codes.astype(np.int32)),
                        _binary(lengths.astype(np.int32)),
                        _binary(chunks.links[places]),
                        _binary(chunks.ends[places]),
                        _binary(nothing),
                        _binary(nothing),
                    ],
                    ["docs", *(c.split()[0] for c in _SHARD.split(", "))],
                )

    return align


def _numbers(batch: pa.RecordBatch, row: int, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the documents of each shard by pair, added up for about MOST_PAIRS pairs at a time."""
    _chunks.cache_clear()
    held = [np.zeros(0, np.int64)] * 2

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(h) for h in held], ["pair", "n"])

    for batch in batches:
        for row in range(batch.num_rows):
            lengths = _numbers(batch, row, "lengths", np.int32)
            times = np.repeat(np.bincount(_numbers(batch, row, "codes", np.int32), minlength=len(lengths)), lengths)
            pair = np.concatenate([held[0], _numbers(batch, row, "links", np.uint32).astype(np.int64)])
            kept, place = np.unique(pair, return_inverse=True)
            held = [kept, np.bincount(place, np.concatenate([held[1], times]), len(kept)).astype(np.int64)]
            if len(kept) > MOST_PAIRS:
                yield out()
                held = [np.zeros(0, np.int64)] * 2
    if len(held[0]):
        yield out()


def _group_texts(a: np.ndarray, b: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The token groups of each distinct chunk, from its links and which tokens end with them."""
    of_a, of_b = ends & 1 > 0, ends & 2 > 0
    names_a, names_b = list(map(str, a[of_a].tolist())), list(map(str, b[of_b].tolist()))
    cuts = np.flatnonzero(ends == 3)
    texts, i, j = [], 0, 0
    for p, q in zip(np.cumsum(of_a)[cuts].tolist(), np.cumsum(of_b)[cuts].tolist()):
        if p - i == 1 and q - j == 1:
            texts.append(f"{names_a[i]}|{names_b[j]}")
        else:
            texts.append(f"{','.join(names_a[i:p])}|{','.join(names_b[j:q])}")
        i, j = p, q
    return [";".join(texts[x:y]) for x, y in itertools.pairwise(np.searchsorted(cuts, bounds).tolist())]


def _reader(pairs: Broadcast, last: bool, n_b: int):
    """Add what a part of the counted pairs says to each document; the last time, a row for each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _chunks.cache_clear()
        known, counts, best = pairs.value
        for batch in batches:
            for row in range(batch.num_rows):
                links = _numbers(batch, row, "links", np.uint32).astype(np.int64)
                bounds = np.r_[0, np.cumsum(_numbers(batch, row, "lengths", np.int32))]
                codes = _numbers(batch, row, "codes", np.int32)
                run = np.r_[0, np.cumsum(_numbers(batch, row, "counts", np.int32))]
                sums = {c: _numbers(batch, row, c, np.int64) for c in ("best", "sums")}
                if len(known):
                    at = np.minimum(np.searchsorted(known, links), len(known) - 1)
                    hit = known[at] == links
                    for name, values in (("best", best[at] & hit), ("sums", np.where(hit, counts[at], 0))):
                        of_chunk = np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][bounds])
                        sums[name] = sums[name] + np.diff(np.r_[0, np.cumsum(of_chunk[codes])][run])
                if not last:
                    part = {c: batch.column(c).slice(row, 1) for c in batch.schema.names}
                    part |= {c: _binary(v) for c, v in sums.items()}
                    yield pa.record_batch(list(part.values()), list(part))
                    continue
                docs = batch.column("docs").slice(row, 1).flatten()
                groups = _group_texts(links // n_b, links % n_b, _numbers(batch, row, "ends", np.uint8), bounds)
                names = list(map(groups.__getitem__, codes.tolist()))
                texts = [";".join(names[p:q]) for p, q in itertools.pairwise(run.tolist())]
                columns = dict(zip([f.name for f in docs.type], docs.flatten()))
                columns |= {"n_best": pa.array(sums["best"]), "count_sum": pa.array(sums["sums"]), "groups": pa.array(texts, pa.string())}
                yield pa.record_batch(list(columns.values()), list(columns))

    return read


def _shards(workspace: Workspace, docs: DataFrame, word_json: str, piece_model: str, text_col: str, keep_text: bool) -> tuple[DataFrame, dict[str, str], int]:
    """The written shards, the name of each column of ``docs`` in them, and the number of pieces."""
    spark = docs.sparkSession
    small_batches(spark)
    content = Path(word_json).read_bytes(), Path(piece_model).read_bytes()
    aligner = Aligner(*content)
    if len(aligner.bytes_a) * aligner.n_b >= 1 << 32:
        raise ValueError("pairs of ids must fit 32 bits")
    _, names = plain_names(docs, (*ADDED, text_col))
    texts = docs.select(F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if keep_text:
        names[text_col] = "text"
    kept = texts.select(*[c for c in texts.columns if c in names.values()])
    inside = kept.select("*", *[F.lit(0).cast("long").alias(c) for c in FIGURES]).schema
    schema = T.StructType([T.StructField("docs", T.ArrayType(inside)), *T.StructType.fromDDL(_SHARD)])
    aligned = _aligned(uuid.uuid4().hex, spark.sparkContext.broadcast(content), kept.columns)
    return workspace.write(texts.mapInArrow(aligned, schema), "shards", file_rows=FILE_SHARDS), names, aligner.n_b


def _pairs(workspace: Workspace, shards: DataFrame, n_b: int) -> DataFrame:
    pairs = shards.select("codes", "lengths", "links").mapInArrow(_count_pairs, "pair long, n long")
    pairs = workspace.write(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pairs").withColumn("b", F.expr(f"pair % {n_b}"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("pair", F.expr(f"pair div {n_b}").alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, word_json: str, piece_model: str, text_col: str = "text") -> DataFrame:
    """How often two ids are linked in all documents: a, b, n, and best (no other a is linked to b more often)."""
    workspace = Workspace(docs.sparkSession, "pairs")
    shards, _, n_b = _shards(workspace, docs, word_json, piece_model, text_col, False)
    return _pairs(workspace, shards, n_b).drop("pair")


def align_tokens(
    docs: DataFrame,
    word_json: str,
    piece_model: str,
    text_col: str = "text",
    keep_text: bool = True,
    part_pairs: int = PART_PAIRS,
) -> DataFrame:
    """The rows of ``docs`` with the alignment of both tokenizers' tokens of space + text.

    Added columns: n_a and n_b tokens; groups, the ids between the byte offsets where
    tokens of both end, as ``a1,a2|b1;a3|b2,b3``, and n_groups; n_links, the pairs of
    tokens whose bytes overlap; count_sum, over the links, how many links of the corpus hold
    the same two ids; n_best, the links whose ids have the highest count of all with that b.

    Null and empty texts, and texts that the tokens' bytes do not give again, have
    no tokens: zeros and an empty string. Repeated rows count as often as they occur;
    equal counts are all best. An empty table stays empty. Texts of any length are
    aligned whole. A column of ``docs`` with the name of an added one is replaced.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "aligned")
    shards, names, n_b = _shards(workspace, docs, word_json, piece_model, text_col, keep_text)
    pairs = workspace.write(_pairs(workspace, shards, n_b).select("pair", "n", "best"), "counts")
    parts = max(1, -(-pairs.count() // part_pairs))
    for part in range(parts):
        rows = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).toArrow().sort_by("pair")
        content = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))
        if part + 1 < parts:
            before, shards = shards, workspace.write(shards.mapInArrow(_reader(content, False, n_b), shards.schema), "shards", file_rows=FILE_SHARDS)
            workspace.drop(before)
    inside = shards.schema["docs"].dataType.elementType
    schema = T.StructType([*inside, *T.StructType.fromDDL("n_best long, count_sum long, groups string")])
    out = shards.mapInArrow(_reader(content, True, n_b), schema)
    order = [c for c in docs.columns if c in names]
    return out.select(*[F.col(names[c]).alias(c) for c in order], *ADDED)
