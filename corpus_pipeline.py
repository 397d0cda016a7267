"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written to the shared folder and
read again as the next one's ``docs``.  All but the last return the columns of ``documents``, whatever else
the table holds.

Cases: null and empty texts fail the quality rules; very long texts go through whole; of documents that tie the
smallest id stays; repeated rows count as copies; an empty table goes through all stages and gives no rows; extra
columns keep their values to the stage before the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import materialise, table
from strata.llm.jaccard_join import keep_first
from strata.llm.pii_crf import mask_pii, train
from strata.llm.quality_rules import keep_clean
from strata.llm.queries import tokenizer_file
from strata.llm.temperature_mix import Target, realise
from strata.llm.word_table_bpe import encode

#: SQL cannot express the CRF and the tokenizer; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at Jaccard 0.8 make: the smallest id.
    Rows that repeat both id and text count as copies; unlike texts under one id, and rows without an id, stay."""
    return keep_first(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return mask_pii(docs, train(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattened source shares, at most four passes over a source, every document at least once."""
    return realise(docs, Target(max_repeats=4), seed=7)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and their decoding, as digests."""
    return encode(docs, tokenizer_file("word_bpe_49k.json"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
