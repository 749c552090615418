"""A training corpus from ``documents`` in five stages, each on all that the one before kept.

Stages give the columns of documents; the last gives packed sequences. Every stage's result is written as Parquet and
read again before the next, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, minhash, mixing, packing, suffixdedup
from quern.llm.common import WORD, documents, stage
from quern.llm.entry import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents that it rejects (no language, or too narrow a margin) go."""
    return langid.identify(docs, keep=COLUMNS).where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by shingles of five words and a similarity of 0.8; one row of each group stays, that of the smallest doc_id.

    Rows are told apart by a hash of all their columns, so null and repeated doc_ids are rows like others. Of rows equal
    in every column one stays. Texts without a word are nobody's copy.
    """
    # The hash passes over nulls: they are told by flags.
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("_row"))
    groups = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).where("n_shingles > 0")
    found = stage(groups.groupBy(F.col("doc_id").alias("_row"), "component_id").agg(F.count("*").alias("copies")), "groups")
    named = found.join(rows.select("_row", "doc_id").distinct(), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("first")).select("first._row")
    stays = stage(found.join(first, "_row").select("_row", "copies"), "kept")
    left = rows.join(found.join(stays, "_row", "left_anti").select("_row"), "_row", "left_anti")
    twice = stays.where("copies > 1").select("_row")
    if twice.limit(1).count():
        left = left.join(twice, "_row", "left_anti").unionByName(left.join(twice, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup of passages of over 50 words; documents that were repeats throughout have no word left and go."""
    found = suffixdedup.dedup(docs, keep=("lang", "source"), as_text=True, window=suffixdedup.WORDS).where((F.col("n_removed") == 0) | F.col("rest").rlike(WORD))
    return found.select("doc_id", F.col("rest").alias("text"), "lang", "source", F.length("rest").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as it is emitted."""
    found = mixing.mix(docs, keep=("text", "lang", "n_chars")).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-two-fit packing: the pieces of every sequence with their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("suffix_dedup", repeats), ("mixing", mixture), ("packing", sequences)]

#: Neither the models nor the tokenizer can be written in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
