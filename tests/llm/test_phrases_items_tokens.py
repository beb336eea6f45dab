"""Phrase mining, decontamination and tokenizer alignment against brute force, on odd and generated rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from rows import DOCS, odd_rows, prose
from tokenizers import Tokenizer

from shelfcast.llm import align, collocations, decontaminate, queries
from shelfcast.llm.fm_index import FmIndex

SMALL = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).cache()


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


# -- phrases ------------------------------------------------------------------


def plain_phrases(rows, longest, least, percent, top):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang)."""
    counts: dict = {}
    for text, lang in rows:
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(plain.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = []
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            parts = [q for q in frequent if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= percent * a for q in parts):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, l, r))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n, -score))
    return out


def mined(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("longest, least, top", [(3, 2, 2000), (2, 3, 7), (5, 2, 50)])
def test_phrases_equal_brute_force(odd, longest, least, top):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert mined(collocations.mine_phrases(odd, longest, least, 50, top)) == sorted(plain_phrases(rows, longest, least, 50, top))


def test_phrases_whose_stripes_are_cut_and_split(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(["the"] * 2 + [f"w{rng.randrange(9)}" if rng.random() < 0.6 else "the" for _ in range(60)]) for _ in range(80)]
    docs = spark.createDataFrame([(t, "en" if k % 3 else None) for k, t in enumerate(texts)], "text string, lang string")
    want = sorted(plain_phrases([(r.text, r.lang) for r in docs.collect()], 3, 3, 50, 2000))
    for name, value in {"HOT_LEAST": 20, "HOT_SHARE": 64, "ROW_ENTRIES": 2, "BUFFER": 300}.items():
        monkeypatch.setattr(collocations, name, value)
    assert mined(collocations.mine_phrases(docs.repartition(5), 3, 3)) == want


def test_entries_of_a_stripe_come_out_once():
    """Rows of a prefix that overlap in several batches add up as a whole."""
    rng = np.random.default_rng(3)
    prefix, word = rng.integers(0, 5, 4000), rng.integers(-50, 50, 4000)
    batches = []
    for part in np.array_split(np.arange(4000), 7):
        batches += collocations._stripe_rows(prefix[part], word[part], np.ones(len(part), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["prefix"], r["part"], r["first"]))
    import pyarrow as pa

    schema = batches[0].schema
    merged = collocations._merge_stripes(iter(pa.RecordBatch.from_pylist(rows[k : k + 3], schema) for k in range(0, len(rows), 3)))
    got: Counter = Counter()
    for batch in merged:
        for r in batch.to_pylist():
            for w, n in zip(r["words"], r["counts"]):
                assert (r["prefix"], w) not in got
                got[r["prefix"], w] = n
            assert r["total"] == sum(r["counts"]) and r["best"] == max(r["counts"])
    assert got == Counter(zip(prefix.tolist(), word.tolist()))


def test_no_phrases_in_an_empty_table(odd):
    assert collocations.mine_phrases(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.mine_phrases(odd, longest=1)


# -- benchmark items ------------------------------------------------------------


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, window):
    """(id, words, hit positions, item ids) of rows (id, text) and items (id, text)."""
    windows: dict = {}
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(plain.LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w = ITEM_WORD.findall((t or "").translate(plain.LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((i, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=lambda r: str(r))


def marked_rows(df):
    out = []
    for r in df.collect():
        hit = [k for s in r.hit_spans for k in range(s.begin_word, s.end_word)]
        assert hit == sorted(set(hit))
        out.append((r.doc_id, r.n_words, hit, r.hit_items))
    return sorted(out, key=lambda r: str(r))


def some_items():
    shared = prose(2, 60)
    return [
        (1, " ".join(shared[:30])), (2, " ".join(shared[25:45])), (2, "another LINE"), (10, "don't stop"), (None, "one two three"),
        (3, None), (4, ""), (5, "!?"), (6, "not in any text at all"), (7, "the same line the same line another line 50"), (8, "日本語"),
    ]


@pytest.mark.parametrize("window", [1, 3, 10])
@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 4])
def test_hits_equal_brute_force(spark, odd, window, block, monkeypatch):
    if block == 4 and window != 3:
        pytest.skip("blocks are tested once")
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block if block > 4 else 40)
    items = spark.createDataFrame(some_items(), "item_id long, text string")
    got = decontaminate.mark_contaminated(odd, items, window=window)
    assert got.columns == [*odd.columns, "n_words", "hit_spans", "hit_items"]
    want = plain_hits([(r.doc_id, r.text) for r in odd.collect()], some_items(), window)
    assert marked_rows(got) == want and any(hit for _, _, hit, _ in want)


def test_spans_are_places_in_the_text_and_can_be_cut(spark):
    text = "Über: ONE two, three four! five"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    marked = decontaminate.mark_contaminated(docs, items, window=3)
    span = marked.where("doc_id = 1").first().hit_spans
    assert [(s.begin_word, s.end_word, text[s.begin_char : s.end_char]) for s in span] == [(1, 4, "ONE two, three")]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(marked).collect()}
    assert cut == {1: "Über:  four! five", 2: None, 3: "nothing here"}


def test_tables_without_rows_have_no_hits(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark_contaminated(odd, none).where("size(hit_spans) > 0").isEmpty()
    items = spark.createDataFrame(some_items(), "item_id long, text string")
    assert decontaminate.mark_contaminated(odd.limit(0), items).count() == 0


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 700).astype(np.uint64) << np.uint64(60)
    begins = np.array([0, 1, 5, 300, 301, 699])
    index = FmIndex(words, begins)
    lengths = rng.integers(0, 6, 200)
    phrases = rng.integers(0, 5, (200, 6)).astype(np.uint64) << np.uint64(60)
    low, high = index.search(phrases, lengths)
    run = np.searchsorted(begins, np.arange(700), "right")
    for p, n, a, b in zip(phrases, lengths, low, high):
        want = [k for k in range(700 - n + 1) if n and (words[k : k + n] == p[:n]).all() and run[k] == run[k + n - 1]]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# -- tokenizers -------------------------------------------------------------------


def plain_alignment(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of rows (id, text), by the libraries on whole texts."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    back = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(rest)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        parts_a = [bytes(back[c] for c in a.id_to_token(k)) for k in ids_a]
        parts_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        owner_a = [k for k, p in enumerate(parts_a) for _ in p]
        owner_b = [k for k, p in enumerate(parts_b) for _ in p]
        links = [(ids_a[x], ids_b[y]) for x, y in dict.fromkeys(zip(owner_a, owner_b))]
        begin = (0, 0)
        for k in range(1, len(whole) + 1):
            if k == len(whole) or (owner_a[k] != owner_a[k - 1] and owner_b[k] != owner_b[k - 1]):
                stop = (owner_a[k - 1] + 1, owner_b[k - 1] + 1)
                groups.append((ids_a[begin[0] : stop[0]], ids_b[begin[1] : stop[1]]))
                begin = stop
        counts.update(links)
        docs.append((doc_id, ids_a, ids_b, groups, links))
    best: dict = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if ids_a else ""
        n_best = sum(counts[link] == best[link[1]] for link in links)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), n_best, sum(counts[link] for link in links), digest))
    return out


def aligned(df):
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return sorted(map(tuple, df.select(*names, digest).collect()), key=key)


SPACED = [
    "a▁b", " lead", "trail ", "two  spaces", "line\nend", "a\n\nb", "a \nb", "\n", "  ", "x\ty", "é\n日本 語", "a\xa0 b", "\x1c a\x1cb",
    "don't 's\n's", "<|endoftext|> x</s>", "\x85 x", "\r\nfoo\r\n bar", "a\n b", "▁", "1 2\n3", "🙂🙂 👩‍👩‍👧 z",
]


@pytest.mark.parametrize("part_pairs", [align.PART_PAIRS, 97])
def test_alignment_equals_brute_force(spark, odd, part_pairs):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(SPACED)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert aligned(align.align_tokens(docs, *FILES, part_pairs=part_pairs)) == sorted(want, key=key)


def test_alignment_query_equals_brute_force(spark):
    out = queries.QUERIES["op13_tokenizer_alignment"](spark, SMALL)
    got = sorted(map(tuple, out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(plain_alignment([tuple(r) for r in rows]))


def test_alignment_keeps_columns_and_empty_tables(spark, odd):
    clash = odd.withColumn("groups", F.lit("x")).withColumn("text_of", F.col("text"))
    out = align.align_tokens(clash, *FILES)
    assert out.columns == [*[c for c in clash.columns if c != "groups"], *align.ADDED]
    assert sorted(map(str, out.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert align.align_tokens(odd.limit(0), *FILES).count() == 0


def test_pair_counts_add_up_to_the_links(odd):
    pairs = align.pair_counts(odd, *FILES)
    out = align.align_tokens(odd, *FILES, keep_text=False)
    assert pairs.agg(F.sum("n")).first()[0] == out.agg(F.sum("n_links")).first()[0]
    assert pairs.groupBy("b").agg(F.max("n") - F.max(F.when(F.col("best"), F.col("n")))).where("`(max(n) - max(CASE WHEN best THEN n END))` <> 0").isEmpty()


def test_files_of_shards_hold_few_rows(spark):
    """A task writes and reads a file's rows at once, and a shard is a row of megabytes; before, a task's shards were one file."""
    texts = spark.range(0, 10, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('the quick brown fox ', {align.SHARD_BYTES // 20 + 9})").alias("text"))
    workspace = align.Workspace(spark, "files")
    shards, *_ = align._shards(workspace, texts, *FILES, "text", False)
    files = [r.n for r in shards.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(files) == 10 and max(files) <= align.FILE_SHARDS
    assert {r.n_a > 0 for r in align.align_tokens(texts, *FILES, keep_text=False).collect()} == {True}
