"""Registered queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies; the files stay out of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_segmented_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op3_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_sampling import segment

    return segment(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_prob_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prob_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=SHARDS)


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_lattice_embeddings, op2_segmented_urls, op3_bitmask_language, op4_sampled_pieces, op5_deobfuscated_pii, op6_risk_controlled_quality, op7_prob_minhash_dedup, op8_token_counts, op9_feistel_shards, op10_hierarchical_packing)}

SHARDS = 40

#: The others' models, tokenizers and transducers have no form in SQL.
ORACLES: dict[str, str] = {
    name: " ".join(sql.split())
    for name, sql in (
        ("op1_lattice_embeddings", oracles.embeddings_sql()),
        ("op6_risk_controlled_quality", oracles.quality_sql()),
        ("op7_prob_minhash_dedup", oracles.near_copies_sql()),
        ("op9_feistel_shards", oracles.shards_sql(SHARDS)),
    )
}
