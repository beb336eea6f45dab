"""Registered queries against SQL on whole tables, and the pipeline against plain versions of its stages."""

from __future__ import annotations

from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pytest
from compare import differences, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfcast.llm import queries

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, MEDIUM), duck(MEDIUM), queries.ORACLES[name])


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))


def test_classifier_is_right_on_held_out_documents(spark):
    out = queries.QUERIES["op8_quality_classifier"](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_rules_reject_what_labels_call_bad(spark):
    out = queries.QUERIES["op6_quality_rules"](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = out.join(labels, "doc_id").select("kept", "quality", "n_words", "js_words").collect()
    assert sum(r.kept for r in rows if r.quality == 0) <= 3
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.95
    assert all((r.js_words is not None) == (r.n_words >= 50) for r in rows)


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen[name] = (before, docs)

    before, after = seen["quality classifier"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id").count()
    assert after.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * good
    assert after.join(labels.where("quality = 0"), "doc_id").count() <= 0.1 * before.join(labels.where("quality = 0"), "doc_id").count() + 1

    before, after = seen["line dedup"]
    texts = [t.text for t in after.select("text").collect()]
    kept = [tuple(plain.words(x)) for t in texts for x in t.split("\n") if plain.words(x)]
    assert len(kept) == len(set(kept))
    assert all(plain.words(t) for t in texts)

    before, after = seen["n-gram Jaccard join"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in plain.near_components(rows, 5, 80)}

    before, after = seen["mixing sources"]
    copies = Counter(r.doc_id for r in after.collect())
    assert set(copies) <= {r.doc_id for r in before.collect()} and max(copies.values()) <= 3

    before, after = seen["BPE encoding"]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.count() == before.count()
    for r in after.collect():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids

    whole = corpus_pipeline.run(spark, SMALL).select("doc_id", F.sha2("token_ids", 256).alias("ids")).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, after.select("doc_id", F.sha2("token_ids", 256).alias("ids")).collect()))


def test_last_stage_decodes_what_it_encodes(spark):
    texts = ["Some words, twice some words.", "Übung  日本語\n\tend", "", None]
    docs = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text), (3, text + " more"), (None, text), (4, "alone here"), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL)
    assert sorted((str(r.doc_id), r.text is not None) for r in out.collect()) == [
        ("1", True), ("4", True), ("5", False), ("5", False), ("6", True)
    ]
