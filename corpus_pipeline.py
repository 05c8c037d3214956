"""The corpus pipeline: five stages from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import byte_cnn, mixing, packing
from loomstead.llm.common import staged, unstage
from loomstead.llm.divergence import quality_rules
from loomstead.llm.jaccard_join import jaccard_groups
from loomstead.llm.queries import table, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Probability of the best language under which a document is rejected.
LEAST_LANGUAGE = 0.4


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with LEAST_LANGUAGE at least.

    Null texts and texts without a letter are rejected; where no document has
    a language, none can be learned and all are. Nulls in other columns,
    repeated rows and ties stay as they are; an empty table gives none; other
    columns are dropped.
    """
    told = byte_cnn.identify(docs, byte_cnn.learn(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and do not diverge from their language.

    Null and short texts are rejected; a null language is judged by the
    nearest reference. Other nulls and repeated rows stay; an empty table
    gives none; other columns are dropped.
    """
    return quality_rules(docs).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows with that id and differing texts are all one document of the group;
    of repeated rows one stays. Null ids stay only where a group has no other.
    """
    groups = jaccard_groups(docs, words=5, percent=80)
    shown = groups.groupBy("root", F.when(F.col("set_id").isNull(), F.xxhash64("doc_id", "text_hash")).alias("alone")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("x")
    )
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_hash"))
    kept = shown.select("x.doc_id", "x.text_hash").select(key.alias("key")).distinct()
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.col("text"))).withColumn("key", key)
    found = rows.join(kept.hint("merge"), "key", "left_semi")  # dealt out by key once, for the join and for repeated rows
    return found.dropDuplicates(["key", "doc_id", "text_hash"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words are taken by no mix and go. Null sources are a
    source of their own. Rows that share an id and a source are one document
    to the mix, taken as often as the first of them; null ids likewise. An
    empty table gives none; other columns are dropped.
    """
    taken = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("id"), "source", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = taken.dropDuplicates(["id", "source"]).withColumnRenamed("source", "of")
    joined = docs.select(*COLUMNS).join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 2048 tokens; null texts are empty, repeated rows are packed each, an empty table gives none."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language", identify_languages),
    ("quality", apply_quality_rules),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Learned models and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder, read by the next and then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), name)
        unstage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
