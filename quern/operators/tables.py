"""Cutting lineage in iterative operators: written tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder in spark.checkpoint.dir; a folder of this machine only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again."""
    path = folder(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_cut = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``cut`` that no later plan reads."""
    path = getattr(df, "_quern_cut", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks(df: DataFrame) -> int:
    """Partitions of rows that take long: by cores, not by bytes, as adaptive execution would have them."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


SALT = 64


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds rank (from 0, by ``order``) over the whole table: rows go to balanced ranges, ranks are places in a range plus the counts
    of the ranges before, a table of one row per range. Rows that are equal in ``order`` are ranked in any order."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    salted = df.withColumn("_salt", F.monotonically_increasing_id() % SALT)
    placed = cut(salted.repartitionByRange(*cols, F.col("_salt")).sortWithinPartitions(*cols, F.col("_salt")).drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    per = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    per = per.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(per), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
