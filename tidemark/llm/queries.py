"""The registered queries of this subpackage: one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, filter_audit, language_id, merkle, mixing, oracles, pii, secret_scan, sentence_pieces, simhash, suffix_dedup, token_counts, toxicity, winnowing
from tidemark.llm.base import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; the lexicon is learned from the labels outside the held-out fold. Null and empty texts score too."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, whether it is over the limit, its half's tokens and its cut."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null texts have none, null is a source of its own."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document counts as a repository, its source as the owner."""
    return secret_scan.digest(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in every document, within their edit budget; documents without one give no row."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the next document's."""
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the texts outside the held-out fold; `und` without a letter."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, remainder(3) != 1)
    return language_id.predict(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document; null texts have none."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier 100-byte string, and a digest of the rest."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without a word have fingerprint zero and are linked."""
    return simhash.link(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in each of their orders."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and digests of the ids and of the decoded text, of every document."""
    return sentence_pieces.digest(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and digest of the proof of every document, and the root that a tampered copy gives."""
    return merkle.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_mixing, op4_secret_scan, op5_decontamination, op6_winnowing, op7_language_id, op8_pii, op9_suffix_dedup, op10_simhash, op11_filter_audit, op12_sentence_pieces, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op4_secret_scan": oracles.OP4, "op11_filter_audit": oracles.OP11, "op13_merkle_manifest": oracles.OP13}
