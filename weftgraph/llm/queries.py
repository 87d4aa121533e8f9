"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, fingerprint, html_extraction, jaccard_join, language_id, license_scan, lm_scoring, packing, quality_classifier, quality_rules, suffix_dedup, whitening
from .common import checkpoint, held_out, table
from .oracles import ORACLE_SQL


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned without the rows whose crc32 modulo 5 is 0."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = quality_classifier.fit(docs, labels)
    return quality_classifier.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted"
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies and number of links of every document: five words a shingle, similarity from 0.8."""
    return jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, with digests of the ids and of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts of every document, with the verdict of the line rules."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur anywhere else."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned without the rows whose crc32 modulo 4 is 2."""
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs, ~held)
    return language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 tokens, packed into sequences of 4096."""
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(checkpoint(narrow))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch fingerprints of every document and its edited version, and their likeness."""
    docs = table(spark, sf_dir, "documents")
    return fingerprint.compare_versions(docs, paragraph_end=fingerprint.SENTENCE_END, stretch=fingerprint.STRETCH_CHARS).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backoff score of every document under the bigram counts of all others."""
    return lm_scoring.score(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "n_found",
        F.round("log_score", 3).alias("log_score"),
        F.round("mean_log_score", 4).alias("mean_log_score"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's coordinates on the sixteen directions of most variance, scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the paths on which the pages of its host agree."""
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, with the links' counts over all documents."""
    byte_path, piece_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), byte_path, piece_path, public_tokenizers.PATTERN, digests=True)
    return found.withColumnRenamed("groups", "groups_sha256")


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_fingerprint": op9_fingerprint,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_whitening": op11_whitening,
    "op12_html_extraction": op12_html_extraction,
    "op13_alignment": op13_alignment,
}
