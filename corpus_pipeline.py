"""From raw documents to token ids, as stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import bpe, lines, mixture, ngram_join, quality
from shelfcast.llm.tables import Workspace
from shelfcast.session import ship_package, small_batches

# Near duplicates: five-word shingles, a similarity of 0.8 or more.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80
# Documents scored below this go. It is lower than the query's threshold: a document is only
# rejected where the model takes label 0 to be the likelier one.
REJECT_BELOW = 0.5
TOKENIZER = "word_bpe_49k.json"


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    _prepare(spark)
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model)
    return scored.where(F.col("quality_score") >= REJECT_BELOW).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document whose lines all occur elsewhere goes.

    n_chars follows the text. Documents that had no line with a word stay.
    """
    _prepare(spark)
    out = lines.drop_repeated_lines(docs)
    changed = F.col("n_dropped") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.where((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines"))).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Rows that repeat this id are told apart by their text, equal ones not at all.
    """
    _prepare(spark)
    workspace = Workspace(spark, "near")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    groups = ngram_join.near_duplicate_components(keyed, shingle=SHINGLE_WORDS, percent=NEAR_PERCENT)
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    sets = groups.where("n_shingles > 0").select("component_id", member.alias("member"))
    # A component without any id is told by its members' texts instead.
    sets = sets.select(
        F.struct(F.coalesce("component_id", F.col("member.text_hash")).alias("of"), F.col("component_id").isNull().alias("no_id")).alias("group"),
        "member",
    )
    sets = workspace.write(sets, "members")
    first = sets.groupBy("group").agg(F.min("member").alias("first"))
    place = [F.col("member.doc_id").alias("at_id"), F.col("member.text_hash").alias("at_hash")]
    gone = sets.join(first, "group").where(F.col("member") != F.col("first")).select(*place, F.lit(True).alias("gone")).distinct()
    # Kept rows that stand in the table more than once.
    again = sets.groupBy("member").count().where("count > 1").select(*place, F.lit(False).alias("gone"))
    again = again.join(gone, ["at_id", "at_hash"], "left_anti")
    marks = workspace.write(gone.unionByName(again), "marks")
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.xxhash64("text") == F.col("at_hash"))
    marked = docs.join(marks, same, "left").where(F.col("gone").isNull() | ~F.col("gone"))
    single = marked.where("gone is null").select(*docs.columns)
    repeated = marked.where("gone is not null").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return single.unionByName(repeated)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    _prepare(spark)
    return mixture.mix_sources(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids, the text decoded from them and n_tokens of every row."""
    _prepare(spark)
    out = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER))
    return out.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources", mix_sources),
    ("BPE encoding", bpe_codec),
]

# The classifier and the tokenizer have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    workspace = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = workspace.write(stage(spark, docs, sf_dir), stage.__name__)
        workspace.release()
    return STAGES[-1][1](spark, docs, sf_dir)
