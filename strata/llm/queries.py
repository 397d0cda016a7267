"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def tokenizer_file(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@register("op9_word_table_bpe")
def op9_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.word_table_bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digests=True)


@register("op10_repair_token_files")
def op10_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.repair_tokens import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def _rules_sql() -> str:
    from strata.llm.quality_rules import ORACLE as sql

    return sql


@register("op1_quality_rules", _rules_sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strata.llm import quality_rules as Q

    rows = Q.ledger(table(spark, sf_dir, "documents"), keep=("doc_id",))
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(Q.BASE).cast("bigint")) != 0
    return rows.select("doc_id", *Q.MEASURES[:5], base_failed.alias("base_failed"), Q.passes().alias("kept"), "fail_bits")


@register("op2_language_ppm")
def op2_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strata.llm import language_ppm as L

    docs = table(spark, sf_dir, "documents")
    model = L.learn(docs.where(L.fold() != 2).select("text", "lang"))
    rows = docs.select("doc_id", "text", F.coalesce(L.fold() == 2, F.lit(False)).alias("held_out"))
    return L.predict(rows, model, keep=("doc_id", "held_out"))


@register("op3_secret_randomness")
def op3_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.secret_randomness import find_secrets

    rows = find_secrets(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@register("op7_pii_crf")
def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strata.llm import pii_crf as C

    docs = table(spark, sf_dir, "documents")
    rows = C.find_pii(docs, C.train(docs), keep=("doc_id",))
    return rows.select("doc_id", *[f"n_{k}" for k in C.KINDS], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@register("op4_collision_ann")
def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strata.llm.collision_ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def _preference_sql() -> str:
    from strata.llm.preference_format import ORACLE as sql

    return sql


@register("op5_preference_format", _preference_sql())
def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.preference_format import format_preferences, pairs_by_id

    return format_preferences(pairs_by_id(table(spark, sf_dir, "conversations")))


def _mix_sql() -> str:
    from strata.llm.temperature_mix import ORACLE as sql

    return sql


@register("op6_temperature_mix", _mix_sql())
def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' own size as budget, 98 % of the largest entropy, at most four passes over a source."""
    from pyspark.sql import functions as F

    from strata.llm.temperature_mix import Target, mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, Target(entropy=0.98, max_repeats=4, budget_share=1.0), seed=7)
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), "mix_key", "copies", "exponent")


def _merkle_sql() -> str:
    from strata.llm.merkle_manifest import ORACLE as sql

    return sql


@register("op11_merkle_manifest", _merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.merkle_manifest import audit

    return audit(table(spark, sf_dir, "documents"))


@register("op13_byte_word_shuffle")
def op13_byte_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.byte_word_shuffle import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), digests=True)


def _hard_sql() -> str:
    from strata.llm.hard_negatives import ORACLE as sql

    return sql


@register("op12_hard_negatives", _hard_sql())
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))
