"""The corpus operators as queries over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annoweave.llm import alignment, ann, exact_dedup, jaccard, language_id, licenses, lm_scoring, mixing, packing, pii, search, simhash, toxicity
from annoweave.llm.base import read_table

#: What the fingerprint contract asks for: four-word shingles, links at four bits or fewer.
SHINGLE, BUDGET = 4, 4
#: What the join's contract asks for: four-word shingles, links at 0.85 or more.
JOIN_WORDS, JOIN_PERCENT = 4, 85


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_to_every_nth(read_table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read_table(spark, sf_dir, "documents"), number="replica")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"), SHINGLE, BUDGET)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(read_table(spark, sf_dir, "documents"), JOIN_WORDS, JOIN_PERCENT).drop("text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_pii, op2_ann, op3_licenses, op4_lm_score, op5_mixing, op6_exact_dedup,
            op7_simhash, op8_toxicity, op9_language_id, op10_packing, op11_alignment, op12_search, op13_jaccard,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ann": ann.ORACLE_SQL,
        "op3_licenses": licenses.ORACLE_SQL,
        "op5_mixing": mixing.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_search": search.ORACLE_SQL,
        "op13_jaccard": jaccard.oracle_sql(JOIN_WORDS, JOIN_PERCENT),
    }
