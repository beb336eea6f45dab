"""Operators on documents against brute force, over rows with every oddity, and over empty tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import public_tokenizers
import pytest
import rows as fixture_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm import bpe, lines, mixture, ngram_join, packing, passages, quality, rules

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows.odd_rows(), fixture_rows.DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], fixture_rows.DOCS)


def key(x):
    return (x is None, x if x is not None else 0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_components_equal_all_pairs(docs, n, percent):
    out = ngram_join.near_duplicate_components(docs, shingle=n, percent=percent)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["n_shingles", "component_id"]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=lambda r: tuple(map(key, r)))
    want = sorted(plain.near_components(rows_of(docs), n, percent), key=lambda r: tuple(map(key, r)))
    assert got == want


def test_a_chain_of_near_documents_is_one_component(spark):
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        words = words[:]
        words[(k * 5) % 300] = f"new{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = ngram_join.near_duplicate_components(docs, shingle=3, percent=90).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted(
        (i, c) for i, _, c in plain.near_components(rows, 3, 90)
    )


def line_truth(docs, percent=lines.PERCENT):
    """The places of each group of lines near by edit similarity, from all pairs of lines."""
    seen, place = {}, defaultdict(set)
    for i, text in rows_of(docs):
        for _, number, words, starts, sizes in lines.line_table(pa.array([text], pa.string())):
            ids = lines.line_ids(words, starts, sizes)
            for k in range(len(ids)):
                node = int(ids[k])
                seen[node] = words[starts[k] : starts[k] + sizes[k]].tolist()
                place[node].add((i, text, int(number[k])))
    nodes = list(seen)
    groups = plain.Groups(len(nodes))
    for a in range(len(nodes)):
        for b in range(a):
            u, v = seen[nodes[a]], seen[nodes[b]]
            most = max(len(u), len(v)) * (100 - percent) // 100
            if abs(len(u) - len(v)) <= most and plain.edit_distance(u, v) <= most:
                groups.link(a, b)
    gathered = defaultdict(set)
    for k, node in enumerate(nodes):
        gathered[groups.find(k)] |= place[node]
    return gathered


def test_one_occurrence_of_each_group_of_lines_stays(docs):
    out = lines.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text")).collect()
    hashes = {(r.doc_id, r.text): r.hash for r in rows}
    gathered = line_truth(docs)
    gone = defaultdict(set)
    for group in gathered.values():
        order = sorted(group, key=lambda p: (p[0] is not None, p[0] or 0, hashes[p[:2]], p[2]))
        for i, text, number in order[1:]:
            gone[(i, text)].add(number)
    want = Counter()
    for r in rows:
        left = r.text
        if left is not None:
            left = "\n".join(x for k, x in enumerate(left.split("\n")) if k not in gone[(r.doc_id, r.text)])
        want[(r.doc_id, left, len(gone[(r.doc_id, r.text)]))] += 1
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in out.collect()) == want


def edited_lines(rng, count, sizes, share):
    """Lines of ``sizes`` words and two copies of each, with about this share of words edited in each copy."""
    short = ["a", "to", "of", "is", "|"]

    def word():
        return short[rng.integers(5)] if rng.random() < 0.4 else f"word{rng.integers(300)}"

    rows = []
    for k in range(count):
        line = [word() for _ in range(rng.integers(*sizes))]
        for copy in range(3):
            rows.append((3 * k + copy, " ".join(line)))
            line = line[:]
            for _ in range(max(1, int(len(line) * share))):
                at = int(rng.integers(len(line) + 1))
                line[at : at + int(rng.integers(2))] = [word()] if rng.random() < 0.7 else []
            line = line or ["one"]
    return rows


@pytest.mark.parametrize("sizes, share, least", [((1, 9), 0.1, 1.0), ((8, 40), 0.05, 0.97), ((8, 40), 0.12, 0.8)])
def test_near_lines_are_found(spark, sizes, share, least):
    rows = edited_lines(np.random.default_rng(11), 80, sizes, share)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # Each text is one line, so a group keeps the document with the smallest id.
    want = {i for group in line_truth(docs).values() for i, *_ in sorted(group)[1:]}
    got = {r.doc_id for r in lines.drop_repeated_lines(docs).collect() if r.n_dropped}
    assert got <= want
    assert len(got) >= least * len(want) > 40


def test_lines_one_edit_apart_share_a_key_up_to_nine_words():
    rng = np.random.default_rng(12)
    for _ in range(400):
        a = rng.integers(0, 12, int(rng.integers(4, 10))).tolist()
        b = a[:]
        at = int(rng.integers(len(b)))
        b[at : at + int(rng.integers(2))] = rng.integers(0, 12, rng.integers(2)).tolist()
        most = max(len(a), len(b)) * 20 // 100
        if a == b or max(len(a), len(b)) > lines.ONE_EDIT or plain.edit_distance(a, b) > most:
            continue
        words = np.array(a + b, np.uint64)
        starts, sizes = np.array([0, len(a)]), np.array([len(a), len(b)])
        line, keys = lines.near_keys(lines.mix(words), starts, sizes)
        assert set(keys[line == 0]) & set(keys[line == 1])


def test_parities_differ_by_two_an_edit_at_most():
    rng = np.random.default_rng(13)
    for _ in range(100):
        a = rng.integers(0, 50, int(rng.integers(1, 60))).tolist()
        b = a[:]
        for _ in range(3):
            at = int(rng.integers(len(b) + 1))
            b[at : at + int(rng.integers(2))] = rng.integers(0, 50, rng.integers(2)).tolist()
        if not b:
            continue
        x, y = lines.parities(np.array(a + b, np.uint64), np.array([0, len(a)]), np.array([len(a), len(b)])).T
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= 2 * plain.edit_distance(a, b)


def test_near_lines_of_the_given_documents_share_a_key(spark):
    """Recall of the keys over all near pairs, which must share some of their word pairs."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    found = {}
    for _, _, words, starts, sizes in lines.line_table(pa.array(texts, pa.string())):
        for k, node in enumerate(lines.line_ids(words, starts, sizes).tolist()):
            found[node] = words[starts[k] : starts[k] + sizes[k]].tolist()
    rows, grams = list(found.values()), defaultdict(set)
    for k, row in enumerate(rows):
        for pair in zip(row, row[1:]):
            grams[pair].add(k)
    met = Counter()
    for members in grams.values():
        members = sorted(members)
        met.update((a, b) for n, a in enumerate(members) for b in members[n + 1 :])
    sizes = np.array([len(r) for r in rows])
    line, keys = lines.near_keys(np.array([w for r in rows for w in r], np.uint64), np.cumsum(sizes) - sizes, sizes)
    own = defaultdict(set)
    for k, key_ in zip(line.tolist(), keys.tolist()):
        own[k].add(key_)
    near, hit = 0, 0
    for (a, b), both in met.items():
        longer = max(sizes[a], sizes[b])
        most = longer * 20 // 100
        if both * 4 >= longer - 1 - 2 * most and plain.edit_distance(rows[a], rows[b]) <= most:
            near, hit = near + 1, hit + bool(own[a] & own[b])
    assert near > 20 and hit >= 0.9 * near


def test_sequences_are_near_as_their_edit_distance_says():
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(600):
        n = int(rng.integers(1, 400 if k % 50 == 0 else 40))
        a = rng.integers(1, 30, n).tolist()
        b = a[:]
        for _ in range(int(n * rng.random() * 0.4)):
            at = int(rng.integers(len(b) + 1))
            b[at : at + int(rng.integers(2))] = rng.integers(1, 30, rng.integers(3)).tolist()
        pairs.append((a, b or [1]) if k % 2 else (b or [1], a))
    sides = [pa.array([np.array(p[s], np.uint32).tobytes() for p in pairs], pa.binary()) for s in (0, 1)]
    for percent in (80, 90, 100):
        got = lines.near_sequences(*sides, percent).tolist()
        want = [plain.edit_distance(a, b) <= max(len(a), len(b)) * (100 - percent) // 100 for a, b in pairs]
        assert got == want and 20 < sum(want)
    assert lines.near_sequences(sides[0][:0], sides[1][:0], 80).tolist() == []


@pytest.mark.parametrize("least", [33, 50])
def test_repeated_passages_cover_what_all_windows_cover(docs, least):
    got = defaultdict(set)
    for r in passages.repeated_passages(docs, least_words=least).collect():
        got[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    want = defaultdict(set)
    for (i, _), covered in plain.repeated_word_places(rows_of(docs), least).items():
        want[i] |= covered
    assert got == want


def covered_places(out):
    got = defaultdict(set)
    for r in out.collect():
        got[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    return got


def test_passages_that_others_hide_are_found(spark):
    # Around one gram x and y share 9 words on each side, and each shares more with others on one side.
    def text(name, seed):
        own, both = [f"{name}{k}" for k in range(112)], [f"s{seed}w{k}" for k in range(50)]
        return " ".join(own[:31] + both + own[81:])

    def places(seed):
        found = passages.suffixes(pa.array([text("x", seed)]), 50)
        return [p for _, pos, *_ in found for p in pos.tolist() if 31 <= p <= 49]

    # The gram in the middle of the shared words must be the one that content selects.
    seeds = [k for k in range(400) if places(k) == [40]][:8]
    rows, twins = [], {}
    for seed in seeds:
        # Beyond the nine words, x and y go on differently; five others follow each of them there, five precede it.
        x, y = (text(f"{n}{seed}n", seed).split() for n in ("x", "y"))
        twins |= {len(rows): len(rows) + 1, len(rows) + 1: len(rows)}
        texts = [x, y]
        for k in range(20):
            base, own = (x, y)[k % 2], [f"z{seed}n{k}n{j}" for j in range(112)]
            texts.append(own[:23] + base[23:72] + own[72:] if k % 4 < 2 else own[:40] + base[40:89] + own[89:])
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(texts)]
    want = {i: c for (i, _), c in plain.repeated_word_places(rows, 50).items()}
    assert len(seeds) == 8 and set(want) == set(twins)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = passages.repeated_passages(docs)
    assert covered_places(out) == want
    assert {r.doc_id: r.twin_id for r in out.collect()} == twins


def test_passages_around_a_frequent_gram_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(21)
    gram = [f"g{k}" for k in range(34)]
    # Few words around a gram that all documents share, so passages meet on every mix of sides.
    rows = []
    for k in range(1600):
        left = [f"l{j}x{int(rng.random() < 0.3)}" if j > 20 else f"l{k}x{j}" for j in range(40)]
        right = [f"r{j}x{int(rng.random() < 0.3)}" if j < 14 else f"r{k}x{j}" for j in range(40)]
        rows.append((k, " ".join(left + gram + right)))
    want = {i: c for (i, _), c in plain.repeated_word_places(rows, 50).items()}
    assert len(want) > 20
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert covered_places(passages.repeated_passages(docs)) == want


def test_bpe_equals_the_library_both_ways(docs):
    out = bpe.encode_decode(docs, TOKENIZER, lexicon_words=200).select("doc_id", "token_ids", "decoded").collect()
    got = Counter((r.doc_id, bytes(r.token_ids), r.decoded) for r in out)
    want = Counter()
    for i, text in rows_of(docs):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want[(i, np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_token_files_hold_every_id_in_order(docs):
    files = packing.write_token_files(docs, TOKENIZER, end_id=2)
    assert files.bits == 16
    got = sorted(packing.read_token_files(files).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.token_ids) // 4
    want = Counter(
        (i, np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows_of(docs)
    )
    assert Counter((r.doc_id, bytes(r.token_ids)) for r in got) == want


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_packed_blocks_give_any_range(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 9001).astype(np.uint32)
    payload, offsets = packing.pack_blocks(ids, bits)
    assert len(payload) <= -(-9001 // 8) * bits + 2 * bits
    for begin, end in ((0, 9001), (0, 0), (5, 6), (4095, 4097), (8190, 9001)):
        got = packing.unpack_range(payload, offsets, len(ids), bits, begin, end)
        assert (got == ids[begin:end]).all()


def test_rules_count_like_plain_python(docs):
    out = rules.apply_rules(docs, keep_cols=("doc_id", "text", "node"))
    for r in out.collect():
        counts = plain.form_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.kept and r.base_failed)
        assert r.js_characters is None or 0 <= r.js_characters <= 1
        assert (r.js_characters is None) or r.n_words >= rules.LEAST_WORDS


def test_distance_of_histograms(spark):
    def at(p, q):
        arrays = [F.array(*[F.lit(x).cast("long") for x in side]) for side in (p, q)]
        return spark.range(1).select(rules.distance(*arrays).alias("d")).first().d

    assert at([1, 2, 3], [2, 4, 6]) == pytest.approx(0)
    assert at([1, 0], [0, 5]) == pytest.approx(1)
    assert at([0, 0], [1, 1]) is None
    p, q = np.array([3, 1]) / 4, np.array([1, 3]) / 4
    m = (p + q) / 2
    assert at([3, 1], [1, 3]) == pytest.approx(np.sqrt((p @ np.log2(p / m) + q @ np.log2(q / m)) / 2))


def test_a_text_in_strange_characters_diverges(spark):
    good = [(k, " ".join(f"the word{k}x{j} of" for j in range(40)), "en") for k in range(30)]
    odd = (99, " ".join("%#%&|" + str(j) for j in range(120)), "en")
    short = (98, "%# %& $$ ** || << >> ## %% && $$ ++", "en")
    df = spark.createDataFrame([*good, odd, short], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in rules.apply_rules(df).collect()}
    assert not kept[99] and kept[98] and all(kept[k] for k in range(30))


def test_a_long_text_without_common_words_diverges(spark):
    good = [(k, " ".join(f"the word{k}x{j} of{'' if j % (k + 2) else ' to'}" for j in range(40)), "en") for k in range(60)]
    odd = (99, " ".join(f"noun{j}" for j in range(200)), "en")
    other = (98, odd[1], None)
    df = spark.createDataFrame([*good, odd, other], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in rules.apply_rules(df).collect()}
    assert rows[99].js_words > 0.5 and rows[99].js_characters < rules.MOST_CHARACTERS and not rows[99].kept
    # Alone in its language it is what is usual there.
    assert rows[98].js_words == 0 and rows[98].kept
    assert all(rows[k].kept and rows[k].js_words is not None for k in range(60))


def test_mixture_reaches_its_targets(spark):
    rows = [(k, " ".join(["w"] * (20 + k % 30)), f"s{k % 5}" if k % 3 else "s0") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixture.plan_mixture(df)
    by = plan.groupBy("source").agg(
        F.sum("mix_size").alias("size"),
        F.max("mix_source_size").alias("told"),
        F.max("mix_target").alias("target"),
        F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        F.max("mix_copies").alias("most"),
    ).collect()
    assert sum(r.target for r in by) == pytest.approx(sum(r["size"] for r in by))
    for r in by:
        assert r["size"] == r.told and r.target <= 3 * r.told and r.most <= 3
        assert r.taken == pytest.approx(r.target, rel=0.1)
    again = mixture.plan_mixture(df.repartition(7))
    assert plan.select("doc_id", "mix_copies").exceptAll(again.select("doc_id", "mix_copies")).isEmpty()
    assert mixture.mix_sources(df).count() == plan.agg(F.sum("mix_copies")).first()[0]


def test_mixture_takes_odd_rows(docs):
    plan = mixture.plan_mixture(docs).collect()
    assert len(plan) == docs.count()
    assert all(r.mix_copies == 0 or r.mix_target > 0 for r in plan)
    mixed = mixture.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.mix_copies for r in plan)


def junk(k):
    return " ".join(f"{w}%%% |" for w in ["spam"] * (10 + k % 7))


def test_classifier_learns_and_leaves_held_out_rows_alone(spark):
    rows = [(k, junk(k) if k % 4 == 0 else " ".join(f"word{(k * 7 + j) % 97}" for j in range(30 + k % 20))) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(800)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    out = quality.score_quality(docs, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held]
    assert 100 < len(held) < 300
    assert all((r.quality_score >= 0.7) == (r.doc_id % 4 != 0) for r in held)
    # Wrong labels on held-out rows change nothing.
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train_quality(docs, wrong)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))


def test_classifier_takes_odd_rows_and_no_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score_quality(docs, quality.train_quality(docs, none))
    assert out.columns == [*docs.columns, "quality_score"]
    assert {r.quality_score for r in out.collect()} == {0.5}
    some = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    scores = [r.quality_score for r in quality.score_quality(docs, quality.train_quality(docs, some)).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_empty_tables_give_empty_results(no_docs, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert ngram_join.near_duplicate_components(no_docs).count() == 0
    assert lines.drop_repeated_lines(no_docs).count() == 0
    assert passages.repeated_passages(no_docs).count() == 0
    assert bpe.encode_decode(no_docs, TOKENIZER).count() == 0
    assert packing.read_token_files(packing.write_token_files(no_docs, TOKENIZER, end_id=2)).count() == 0
    assert rules.apply_rules(no_docs).count() == 0
    assert mixture.mix_sources(no_docs).count() == 0
    assert quality.score_quality(no_docs, quality.train_quality(no_docs, labels)).count() == 0


def test_stages_hand_texts_to_python_a_few_megabytes_at_a_time(spark):
    import corpus_pipeline

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    texts = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("word "), 2_000).alias("text"))

    def measure(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["bytes"])

    try:
        spark.conf.set(limit, "64m")
        corpus_pipeline.mix_sources(spark, texts, "")
        found = [r.bytes for r in texts.select("text").mapInArrow(measure, "bytes long").collect()]
    finally:
        spark.conf.set(limit, before)
    assert sum(found) > 20_000_000 and max(found) < 6_000_000


def test_rows_of_shared_buckets_are_moved_once(spark):
    from shelfcast.llm.buckets import shared_only

    # Tokens met twice by one node, by two nodes, and once.
    rows = spark.createDataFrame([(1, 10, 0), (1, 10, 1), (2, 10, 0), (2, 11, 0), (2, 11, 0), (3, 12, 0)], "token long, node long, pos int")
    kept = shared_only(rows)
    assert sorted(map(tuple, kept.collect())) == [(2, 10, 0), (2, 11, 0), (2, 11, 0)]
    assert kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_unlike_documents_of_a_family_are_not_paired(spark, monkeypatch):
    # All pairs share rare shingles and stay a little below the threshold.
    base = fixture_rows.prose(31, 300)
    rows = []
    for k in range(90):
        words = base[:]
        for place in fixture_rows.random.Random(k).sample(range(300), 4):
            words[place] = f"own{k}_{place}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, link = [], ngram_join.link_buckets

    def counting(workspace, postings, attributes, first_key, fits, verify, *rest):
        def count(pairs):
            found.append(pairs.count())
            return verify(pairs)

        return link(workspace, postings, attributes, first_key, fits, count, *rest)

    monkeypatch.setattr(ngram_join, "link_buckets", counting)
    out = ngram_join.near_duplicate_components(docs, shingle=3, percent=90).collect()
    want = plain.near_components(rows, 3, 90)
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted((i, c) for i, _, c in want)
    assert len({c for _, _, c in want}) > 80
    assert len(found) == 3 and found[-1] < 90


@pytest.mark.parametrize("outsiders", [3, 1024])
def test_last_round_pairs_all_rows_of_different_components_once(spark, monkeypatch, outsiders):
    from shelfcast.llm import buckets

    monkeypatch.setattr(buckets, "OUTSIDERS", outsiders)
    rng = fixture_rows.random.Random(5)
    # Two buckets with a component of half of the rows, one of single rows, one component alone.
    roots = {node: 0 if node < 15 else 1 if node < 20 else node for node in range(30)}
    buckets_of = {1: range(30), 2: rng.sample(range(30), 20), 3: range(20, 30), 4: range(15)}
    rows = [(token, node, roots[node]) for token, nodes in buckets_of.items() for node in nodes]
    pairs = buckets._across(spark.createDataFrame(rows, "token long, node long, root long"), ["node", "root"])
    got = sorted((r.token, *sorted((r.node_a, r.node_b))) for r in pairs.collect())
    assert got == sorted(
        (token, a, b) for token, nodes in buckets_of.items() for a in nodes for b in nodes if a < b and roots[a] != roots[b]
    )


def test_line_pairs_are_bounded_by_their_lengths_and_met_once(spark, monkeypatch):
    # Long lines with a passage in common, behind beginnings of other words and of two lengths.
    passage = fixture_rows.prose(41, 55)
    rows = [(k, " ".join([f"own{k}_{j}" for j in range(16 if k % 2 else 22)] + passage)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, link = [], lines.link_buckets

    def counting(workspace, postings, attributes, first_key, fits, verify, *rest):
        def count(pairs):
            found.append(pairs.count())
            return verify(pairs)

        return link(workspace, postings, attributes, first_key, fits, count, *rest)

    monkeypatch.setattr(lines, "link_buckets", counting)
    assert {r.n_dropped for r in lines.drop_repeated_lines(docs).collect()} == {0}
    # The bound without the lengths and the further parities left 366.
    assert found and found[-1] < 120
