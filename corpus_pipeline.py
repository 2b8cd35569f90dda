"""A pipeline from raw documents to packed training sequences: each stage calls one operator of ledgerloom.llm.

Every stage takes a table of any size, an empty one too (then it gives no rows), with doc_id, text, source and any other columns,
whatever their names; all but the last return these columns. Any column may hold nulls, texts may be empty or of any length, rows
may repeat. What becomes of each is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import materialize
from ledgerloom.llm.mixing import mixed_documents
from ledgerloom.llm.neardup import NearCopies
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import Sanitiser
from ledgerloom.llm.quality import keep_good
from ledgerloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts (under MIN_WORDS words) are rejected. Rows are judged one by one, so that repeated rows and ties
    stay or go together; very long texts are judged whole.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document of the least doc_id stays.

    Null doc_ids come before all others. Texts without words are copies of each other. Of rows that repeat a doc_id and its words
    one stays, any of them; rows of one doc_id with other words are documents of their own.
    """
    return NearCopies(docs, width=5, similarity=0.8).keep_one()


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that reveal it; no document goes.

    Null texts stay null, empty ones empty. Repeated rows are cleaned alike. n_chars, where there is such a column, follows the text.
    """
    return Sanitiser(docs).clean()


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice.

    Texts without words are never taken. A null source is a source of its own. Rows of one source and doc_id (null too) are taken or
    left together.
    """
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences.

    A null or empty text is its end id alone. Repeated rows are packed each for itself; equal pieces may stand in each other's place.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", pii),
    ("mixing", mixing),
    ("best-fit packing", best_fit_packing),
]

#: The stages hash, tokenise and estimate in ways that SQL doesn't have; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is a table in the shared folder, read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
