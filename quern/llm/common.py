"""Helpers shared by the operators: staged tables, word rules and exact global ranks.

Staged tables are Parquet folders under the cluster's shared folder (``spark.checkpoint.dir``), so that a
lost executor never takes an intermediate result with it; a local folder is made only where that setting
is absent and the master is local (tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch between the JVM and a Python worker: bounds both sides' buffers whatever the texts' lengths.
BATCH_BYTES = 4 << 20
_CACHES: dict[str, object] = {}


def worker_cache(name: str, build):
    """What a Python worker keeps from task to task, one thing at a time: another operator's cache goes first."""
    if name not in _CACHES:
        _CACHES.clear()
        _CACHES[name] = build()
    return _CACHES[name]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES and 2000 rows; limits that are lower already stay."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 2000)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"-?\d+", str(spark.conf.get(key)))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set: a temporary one on a local master, an error on a cluster, whose
    executors could not see it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = staged_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop_staged(*dfs: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_quern_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def n_words(text: Column) -> Column:
    """Number of words, null text: 0. ``regexp_count`` walks the text once and builds no array in the plan."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
