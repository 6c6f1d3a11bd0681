"""Corpus pipeline: five stages over ``documents``.

1. language_id: documents whose language cannot be told go (``langid``).
2. ngram_jaccard: of each group of linked documents one stays (``ngram_join``);
   linked are those that share eight tenths of their shingles of five words.
3. decontamination: documents that hold a benchmark item go (``decontam``).
4. source_mix: documents as often as the mix to target weights takes them
   (``mixing``); documents without words go.
5. token_ids: token files of the mix; a digest row per document, read back
   from the files (``token_files``): doc_id, start, n_tokens, ids_crc32.

Each stage reads what its predecessor wrote, as Parquet in the shared folder.
All stages but the last return the columns of ``documents``.  Null texts,
texts without letters and texts that resemble no learned language end at the
first stage; repeated rows become one at the
second; an empty table passes through as an empty table; further columns of
``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranksmith.llm import decontam, langid, mixing, ngram_join, token_files
from ranksmith.llm.common import bounded_batches, read, stored


NEAR = ngram_join.Rule(width=5, num=8, den=10)
MEMO_ENTRIES = 400_000  # beside what the stages before leave in an executor


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    bounded_batches(spark)
    return langid.keep_identified(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    bounded_batches(spark)
    return ngram_join.one_of_each(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    bounded_batches(spark)
    return mixing.mixed_corpus(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A digest row per document of the token files."""
    bounded_batches(spark)
    return token_files.token_digest(spark, docs, MEMO_ENTRIES)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

# learned languages, components and tokens are not SQL's: tested by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
