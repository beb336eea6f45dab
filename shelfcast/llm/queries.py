"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import align, bpe, chat, collocations, cover_tree, decontaminate, lines, mixture, ngram_join, packing, passages, quality, rules

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Level of the shared words: sources ordered by size / weight reach their stop one after the other.
MIXTURE_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
), s as (
  select source, sum(size) as source_size from d group by source
), w as (
  select *, ((row_number() over (order by (source is null), encode(source)) - 1) % 3 + 1)::double as weight from s
), r as (
  select *, 3.0 * source_size as stop, 3.0 * source_size / weight as turn from w
), p as (
  select *, sum(stop) over (order by turn, encode(source)) as held,
    sum(weight) over (order by turn, encode(source)) as used,
    (select sum(source_size) from s) as words, (select sum(weight) from w) as whole
  from r
), l as (
  select coalesce(max((words - held) / (whole - used)) filter (
      used < whole and turn <= (words - held) / (whole - used)), any_value(words / whole)) as level from p
), t as (
  select source, source_size, case when turn <= level then stop else level * weight end as target from p, l
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5('mixture:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / (2::double ** 52) as u
  from d join t on d.source is not distinct from t.source
)
"""


@query("op1_mix_sources", MIXTURE_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of each document."""
    plan = mixture.plan_mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


JOIN_SQL = r"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as wl from documents
), g as (
  select distinct rid, gram from (
    select rid, case when len(wl) < 3 then array_to_string(wl, ' ') else array_to_string(wl[i:i+2], ' ') end as gram
    from (select rid, wl, unnest(range(1, greatest(len(wl) - 1, 2))) as i from d where len(wl) > 0))
), n as (
  select rid, count(*) as n from g group by rid
), c as (
  select x.rid as a, y.rid as b, count(*) as shared from g x join g y on x.gram = y.gram and x.rid <> y.rid group by all
), e as (
  select a, b from c join n p on p.rid = a join n q on q.rid = b where 100 * shared >= 90 * (p.n + q.n - shared)
), r as (
  select rid, doc_id as root from d
  union
  select b, root from r join e on r.rid = e.a
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from d left join n using (rid) join (select rid, min(root) as component_id from r group by rid) using (rid)
"""


@query("op2_ngram_jaccard_join", JOIN_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document: three-word shingles, 90 percent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ngram_join.near_duplicate_components(docs, shingle=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


@query("op3_bpe_codec")
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document, read back from the files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = packing.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.read_token_files(files).select(
        "doc_id",
        "start",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("token_ids").alias("ids_crc32"),
    )


@query("op9_fuzzy_lines")
def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, how many go, and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    keyed = docs.select("doc_id", "text")
    return quality.score_quality(keyed, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op5_repeated_passages")
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 50 words or more that another document has too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.repeated_passages(docs)


RULES_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents
), w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as wl from d
), g as (
  select rid, i, array_to_string(wl[i:i+4], ' ') as gram
  from (select rid, wl, unnest(range(1, len(wl) - 3)) as i from w where len(wl) >= 5)
), c as (
  select rid, count(distinct i + j) as n_repeat_words
  from (select rid, i, unnest(range(5)) as j from (select *, count(*) over (partition by rid, gram) as n from g) where n > 1)
  group by rid
), l as (
  select rid, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid
), f as (
  select w.rid, doc_id, lang, wl, len(wl) as n_words, length(t) as chars,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    length(regexp_replace(t, '[^a-z]+', '', 'g')) as k_lower, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as k_upper,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) as k_digit,
    length(regexp_replace(t, '[^\x{80}-\x{10FFFF}]+', '', 'g')) as k_high,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join c using (rid) left join l using (rid)
), b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f
), h as (
  select rid, lang, base_failed, 'c' as kind, name, n from (
    select rid, lang, base_failed, unnest(['lower', 'upper', 'digit', 'high', 'symbol', 'space', 'mark']) as name,
      unnest([k_lower, k_upper, k_digit, k_high, n_symbols, chars - word_chars,
        word_chars - k_lower - k_upper - k_digit - k_high - n_symbols]) as n from b)
  union all
  select rid, lang, base_failed, 'w', case when word in (WORDS) then word else ' others' end, count(*)
  from (select rid, lang, base_failed, lower(unnest(wl)) as word from b) group by all
), q as (
  select lang, kind, name, sum(n) / sum(sum(n)) over (partition by lang, kind) as q from h where not base_failed group by lang, kind, name
), p as (
  select rid, lang, kind, name, n / nullif(sum(n) over (partition by rid, kind), 0) as p from h
), z as (
  -- A name that only the language has adds half its share.
  select rid, p.kind,
    sum(case when p > 0 then p * log2(p / ((p + coalesce(q, 0)) / 2)) else 0 end
      + case when q > 0 then q * log2(q / ((coalesce(p, 0) + q) / 2)) else 0 end) + (1 - sum(coalesce(q, 0))) as twice,
    count(q) > 0 as known
  from p left join q on p.kind = q.kind and p.name = q.name and p.lang is not distinct from q.lang group by rid, p.kind
), j as (
  select rid, max(sqrt(greatest(twice / 2, 0))) filter (kind = 'c' and known) as js_c,
    round(max(sqrt(greatest(twice / 2, 0))) filter (kind = 'w' and known), 6) as js_w
  from z group by rid
), e as (
  select *, js_c as js_characters, js_w as js_words from b left join j using (rid)
), u as (
  select lang, count(*)::double as n, sum(m)::double as s, sum(m * m)::double as s2
  from (select lang, round(js_words * 1000000)::hugeint as m from e where n_words >= 50 and not base_failed and js_words is not null)
  group by lang
), v as (
  select lang, greatest((s / n + 2 * sqrt(greatest(s2 / n - (s / n) * (s / n), 0))) / 1000000, 0.15::double) as most from u
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  round(case when n_words >= 50 then js_characters end, 6) as js_characters, case when n_words >= 50 then js_words end as js_words,
  not base_failed and not coalesce(n_words >= 50 and (js_characters > 0.3 or js_words > most), false) as kept
from e left join v on e.lang is not distinct from v.lang
""".replace("WORDS", ", ".join(f"'{w}'" for w in dict.fromkeys(rules.COMMON_WORDS)))


@query("op6_quality_rules", RULES_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form counts of each document and whether the rules keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = rules.apply_rules(docs)
    return out.withColumns({c: F.round(c, 6) for c in ("js_characters", "js_words")})


CHAT_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, replace(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
      '</s>', '<\/s>'), '<s>', '<\s>') as t,
    replace(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
      '</s>', '<\/s>'), '<s>', '<\s>') as r
  from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(r) + length(t) + 17)::bigint as formatted_chars
from e group by conv_id
"""


@query("op4_chat_format", CHAT_SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, read back from its formatted text and loss mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        probe,
    )
    talks = chat.format_turns(chat.with_turns(chat.gather_rows(rows.unionByName(more))))
    back = chat.read_back(talks.select("conv_id", "formatted", "loss_spans"))
    said = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("read_loss", "")
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from (select distinct * from v where vec_id % 100 = 0) q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op7_cover_tree_topk", TOPK_SQL)
def op7_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cover_tree.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


PHRASES_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), p as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as wl from d
), g as (
  select lang, k, array_to_string(wl[i:i+k-1], ' ') as phrase
  from (select lang, wl, k, unnest(range(1, len(wl) - k + 2)) as i from p, (values (1), (2), (3)) t(k) where len(wl) >= k)
), f as (
  select lang, k, phrase, count(*) as a from g group by all
), n as (
  select lang, sum(a)::bigint as n from f where k = 1 group by lang
), c as (
  select *, string_split(phrase, ' ') as w from f where k > 1 and a >= 10
), x as (
  select *, array_to_string(w[1:j], ' ') as head, array_to_string(w[j+1:k], ' ') as tail
  from c, (values (1), (2)) t(j) where j < k
), s as (
  select x.lang, x.phrase, x.k, x.a, x.j, l.a as l, r.a as r,
    ((1000000::hugeint * x.a * x.a) // (l.a::hugeint * r.a))::bigint as score
  from x join f l on l.lang = x.lang and l.phrase = x.head join f r on r.lang = x.lang and r.phrase = x.tail
), m as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1
), o as (
  select lang, part, max(a) as most from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from c where k = 3)
  group by all
), kept as (
  select m.* from m left join o on o.lang = m.lang and o.part = m.phrase and m.k = 2 where coalesce(100 * most < 50 * a, true)
)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
) join n using (lang) where rank <= 2000
"""


@query("op11_phrase_collocations", PHRASES_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of 2 to 3 words of each lang that keep together best."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.mine_phrases(docs, longest=3, least=10, subsumed_percent=50, top=2000)


WINDOWS_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as wl from documents
), b as (
  select item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as wl from benchmark
), v as (
  select distinct item_id, least(len(wl), 10) as size, array_to_string(wl[i:i+9], ' ') as gram
  from (select item_id, wl, unnest(range(1, greatest(len(wl) - 9, 1) + 1)) as i from b where len(wl) > 0)
), g as (
  select rid, i, size, array_to_string(wl[i:i+size-1], ' ') as gram
  from (select rid, wl, size, unnest(range(1, len(wl) - size + 2)) as i
        from d, (select distinct size from v) where len(wl) >= size)
), h as (
  select g.rid, g.i, g.size, v.item_id from g join v using (size, gram)
), c as (
  select rid, count(distinct w) as n_hit from (select rid, unnest(range(i, i + size)) as w from h) group by rid
), t as (
  select rid, count(distinct item_id) as n_items,
    string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by rid
)
select doc_id, len(wl)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join t using (rid)
"""


@query("op12_benchmark_decontamination", WINDOWS_SQL)
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside ten-word windows of benchmark items, and these items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10, keep_text=False)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["begin_word"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned token groups of each document, and how common its links of two ids are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = align.align_tokens(docs, *files, keep_text=False)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return out.withColumn("groups_sha256", digest).drop("groups")
