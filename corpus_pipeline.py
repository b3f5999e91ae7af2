"""A corpus pipeline: each stage calls one of the text operators and works on all that the one before kept.

All stages take empty tables, null and empty texts, null doc_ids, repeated rows and extra columns; what each makes of them
is said by it. All but the last keep every column of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontam, langid, linejoin, simhash
from ledgerloom.llm.common import local_folder, table
from ledgerloom.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: null and empty texts, texts without a letter, and unsure ones. Repeated rows and null doc_ids stay."""
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line (by doc_id, nulls first, and line) go; the documents stay, if need be with an empty text. Repeated rows keep the same lines."""
    return linejoin.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least doc_id, once. Empty texts are one group. Rows without a doc_id stay, one a fingerprint, if no document has theirs."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go, all rows of them. Empty and null texts have none; items without an id or words are left out."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row each; empty texts have no tokens."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The stages' models and joins go beyond SQL. Tests hold lines, near_duplicates and decontamination against brute-force versions,
#: tokens against the tiktoken library and language against its accuracy on held-out documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again in the shared checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or local_folder(spark)
    docs, at = table(spark, sf_dir, "documents"), f"{folder}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
