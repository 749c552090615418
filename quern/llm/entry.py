"""The queries of this subpackage and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, minhash, mixing, packing, quality, sharding, suffixdedup, tokencount, tokenfiles, topk
from quern.llm.common import documents


def vocabulary(name: str) -> str:
    """A public tokenizer's file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=2)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir))
    return found.select("doc_id", (~langid.is_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), payload=F.crc32("ids").alias("ids_crc32"))


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op8_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text`` is what stays, with U+FFFD where half a character is left."""
    found = suffixdedup.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("rest").cast("string")).alias("text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.assess(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenfiles.round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_topk, op3_sharding, op4_langid, op5_mixing, op6_packing, op7_tokencount, op8_suffixdedup, op9_quality, op10_tokenfiles)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": minhash.ORACLE, "op2_topk": topk.ORACLE, "op5_mixing": mixing.ORACLE}
