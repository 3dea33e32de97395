"""A training corpus in five stages, each over all that the one before it kept.

Every stage's rows are written as Parquet in the shared folder and read again as
the next one's documents.  All stages but the last return the columns of their
documents, further ones included, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filigree.llm import decontam, mixing, quality, simhash, tokenbin
from filigree.llm.common import written
from filigree.llm.queries import END_ID, table, tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is that of trusted text of their language and length.

    Null and empty texts and those without a word go; a null language is one of
    its own; rows without an id are judged by their text; repeated rows stay or
    go together; without labels all others stay; no rows give no rows.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five words, a similarity of 0.8 or more.

    Rows that share id and text are one; texts without words are alike; rows
    without an id give way to those with one; no rows give no rows.
    """
    return simhash.keep_similar_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, however long they are.

    Null and empty texts contain nothing and stay, as do null ids and repeated
    rows; null and empty items are nowhere; no rows give no rows.
    """
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, whole.

    A null source is one of its own; texts without words are never taken; rows
    that share an id share what is taken of it; no rows give no rows.
    """
    return mixing.repeated(docs, mixing.mix(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of what is left, as read back: one row per document and repeat.

    A null or empty text is the end id alone; null ids come first; no rows give
    no files and no rows.
    """
    return tokenbin.token_table(docs, tokenizer("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: The perplexity model and XXH64 are beyond DuckDB's SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over all documents; odd rows as each stage says, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
