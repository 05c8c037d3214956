"""The registered queries opN_<name> of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import byte_cnn, license_scan, merkle, mixing, packing, pu_quality, sketches, source_audit, substring_dedup, url_reputation
from loomstead.llm.common import crc32_remainder
from loomstead.llm.divergence import quality_rules
from loomstead.llm.html_text import extract_main_text
from loomstead.llm.jaccard_join import jaccard_groups

#: The rules of op3: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The vocabulary file of op9.
TOKENIZER = "word_bpe_49k.json"
#: The score from which op5 predicts quality.
GOOD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 at least."""
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages; outcomes are those of labelled documents whose lines the pages hold."""
    pages = table(spark, sf_dir, "pages")
    judged = url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = pu_quality.score_quality(docs, pu_quality.learn(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= GOOD, 1).otherwise(0)
    return scored.select("doc_id", (crc32_remainder("doc_id", 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op6_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    told = byte_cnn.identify(docs, byte_cnn.learn(docs))
    return told.select("doc_id", (crc32_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share_percent=150, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return sketches.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op9_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), window=2048, last_id=1)


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules on all documents."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that passages of documents with smaller ids cover, and digests of what stays."""
    cut = substring_dedup.cut_repeats(table(spark, sf_dir, "documents"), least=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of all documents, and the terms that set them apart."""
    return source_audit.audit_sources(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what they show where a fifth of the texts are tampered with."""
    return merkle.audited(table(spark, sf_dir, "documents"), merkle.lowered_in_a_fifth(), fan=16)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_line_blocks, op2_ngram_jaccard_join, op3_url_reputation, op4_license_scan, op5_pu_quality,
        op6_byte_cnn_language, op7_mix_to_weights, op8_scaled_sketches, op9_concat_and_cut, op10_divergence_rules,
        op11_substring_dedup, op12_source_divergence, op13_merkle_manifest,
    )
}

SQL = {
    "op3_url_reputation": url_reputation.oracle(URL_RULES),
    "op4_license_scan": license_scan.oracle(),
    "op7_mix_to_weights": mixing.SQL,
    "op11_substring_dedup": substring_dedup.SQL,
    "op12_source_divergence": source_audit.SQL,
    "op13_merkle_manifest": merkle.oracle(),
}
