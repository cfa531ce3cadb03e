"""From raw documents to packed training sequences: quality rules, line dedup, n-gram Jaccard join, secret scans, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import base, line_dedup, ngram_join, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; so do null and empty texts, which have too few words. The trusted target is what the labels table calls good. A ratio equal to the
    threshold is kept; repeated rows are judged each; a null doc_id is judged like any other; an empty table gives no rows; columns of any name stay."""
    return quality.keep_good(docs, quality.trusted_ids(spark, sf_dir))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents of which no word remains. The earliest place is by doc_id, then by line; exact repeats of a row don't remove each
    other's lines; rows with a null doc_id or text stay as they are, as do empty texts; an empty table gives no rows; columns of any name stay."""
    return line_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: five-word shingles, a similarity of 0.8 or more. Null and empty texts link with nothing; rows with a
    null doc_id stay; rows that repeat a doc_id are one document, and stay or go together; an empty table gives no rows; columns of any name stay."""
    return ngram_join.keep_one(docs, k=5, num=4, den=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; of spans that overlap, by the first one's. Null texts stay null; every row stays, repeated ones too; columns of any name stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document. A null or empty text is its end mark alone; rows are packed each; a null doc_id stays null; an
    empty table gives no rows; other columns are left out."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


#: Bytes of words that a worker remembers in packing: fewer than where packing has the workers to itself, as they still hold what earlier stages needed.
REMEMBERED = 16 << 20

STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_runs),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Hashed ratios, winnowing, checksums and tokens are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`, each over what the one before kept, stored in between; the rows are those of the last. Nulls, ties, repeated rows, texts
    of any length, empty tables and extra columns are as each stage says."""
    docs = base.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = base.written(docs)
    return docs
