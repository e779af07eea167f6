"""A training corpus in five stages, each over all documents that the one before kept.

Toxic documents go; of each group of near-duplicates one stays; documents that hold a benchmark passage go;
live-looking credentials are masked; and the rest is mixed to the target weights of its sources. The last stage
returns what the mix takes: one row a document, with the words taken.

In every stage a null text is an empty one, columns besides those of ``documents`` are left behind, and an empty table
gives an empty one. Rows are what is kept or dropped, not ids: repeated rows, and rows of one or a null doc_id, are
judged each by itself, but for the near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, mixing, near_duplicates, secret_scan, toxicity
from tidemark.llm.base import remainder, table, tuned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.3, as they were; the lexicon is learned from the labels as in op1. Empty texts stay."""
    tuned(spark)
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.below(docs.select(*COLUMNS), lexicon, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more: that of the smallest doc_id.

    Repeated rows and exact copies are one group; texts without a word are copies of each other.
    """
    tuned(spark)
    return near_duplicates.keep_one(docs).select(*COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark within its edit budget; a benchmark without items drops none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials masked and ``n_chars`` made to fit; a document is a repository, its source the
    owner, and all rows without a source are one owner's."""
    return secret_scan.redact(docs, F.col("doc_id"), F.col("source")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words of each and its source's target."""
    return mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scan", mask_secrets),
    ("source mixing", mix_sources),
]

#: SQL expresses neither the learned lexicon nor the cube method; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again by the next."""
    from tidemark.llm.base import checkpoint

    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
