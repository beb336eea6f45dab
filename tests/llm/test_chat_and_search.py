"""Chat layouts and round trips, and exact search, against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import chat, cover_tree, tables

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<<s>s>", "", None, "a</s", "[/INST", "\n퟿日本"]


def test_texts_come_back_whatever_they_hold(spark):
    rows = [(c, t, role, text) for c in range(3) for t, text in enumerate(NASTY) for role in ("user", "assistant")]
    rows += [(None, None, None, None), (7, 1, "[INST]", "x"), (7, 1, "[INST]", "x"), (8, 0, "assistant", "y" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_turns(chat.with_turns(chat.gather_rows(df)))).collect()
    assert len(out) == 6
    for r in out:
        own = [(t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(t.role, t.text) for t in r.read_turns] == [x[1:] for x in own]
        assert list(r.read_loss) == [x[2] for x in own if x[1] == "assistant"]
        assert r.formatted.count("</s>") == len(own)


def test_each_layout_has_its_mapping(spark):
    schema = """id int, messages array<struct<role:string,content:string>>,
        conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string,
        prompt string, response string, completion string, system string, other struct<x:int,y:array<int>>"""
    e = None
    rows = [
        (1, [("user", "q"), ("assistant", "a")], e, e, e, e, e, e, e, e, (1, [2])),
        (2, e, [("human", "q"), ("gpt", "a")], e, e, e, e, e, e, e, e),
        (3, e, e, "q", e, "a", e, e, e, e, e),
        (4, e, e, "q", "more", "a", e, e, e, e, e),
        (5, e, e, e, e, e, "q", "a", e, e, (e, e)),
        (6, e, e, e, e, e, "q", e, "a", e, e),
        (7, e, e, e, e, e, "q", "a", e, "s", e),
        (8, e, e, e, e, e, "q", e, e, e, e),
        (9, [], e, e, e, e, e, e, e, e, e),
    ]
    out = {r.id: r for r in chat.with_turns(spark.createDataFrame(rows, schema)).collect()}
    turns = {k: [(t.role, t.text) for t in r.canonical_turns] for k, r in out.items()}
    plain = [("user", "q"), ("assistant", "a")]
    assert turns[1] == turns[2] == turns[3] == turns[5] == turns[6] == plain
    assert turns[4] == [("user", "q\n\nmore"), ("assistant", "a")]
    assert turns[7] == [("system", "s"), *plain]
    assert turns[8] == [] and out[8].layout is None
    assert turns[9] == [] and out[9].layout == "messages"


def brute(rows, k):
    vectors = [
        (i, [int(np.floor(1024 * x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    queries = {(i, tuple(v)) for i, v in vectors if i % 100 == 0}
    out = []
    for i, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 100)
    monkeypatch.setattr(cover_tree, "PIVOTS", 4)
    rng = np.random.default_rng(8)
    rows = [(int(k), rng.normal(size=8).round(1).tolist()) for k in range(700)]
    rows += [(1000 + k, [0.5] * 8) for k in range(300)]
    rows += [(2000, [0.0] * 8), (2001, [float("nan")] * 8), (2002, [float("inf")] + [0.0] * 7), (2003, None), (2004, [None] * 8)]
    rows += [(2100, [1.0, 2.0]), (2101, [3.0, -1.0]), (2200, []), (None, [1.0] * 8), rows[0], (2300, [1e9] * 8), (2301, [-1e5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 100 == 0, 10).collect())
    assert got == brute(rows, 10)


def test_search_over_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.top_k(df, F.col("vec_id") % 100 == 0, 10).count() == 0
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert cover_tree.top_k(one, F.col("vec_id") % 100 == 0, 10).count() == 0


def test_components_of_long_chains_rings_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 200)]
    edges += [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2000 + (k + 1) % 30) for k in range(30)]
    edges += [(3005, 3001), (3001, 3005), (3003, 3005), (4000, 4000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r.node: r.root for r in tables.components(tables.Workspace(spark, "test"), df).collect()}
    groups = {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(60)}
    groups |= {2000 + k: 2000 for k in range(30)} | {3001: 3001, 3003: 3001, 3005: 3001}
    assert got == groups
