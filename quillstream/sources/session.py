"""Session helpers: worker import path, shared folder, materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch on its way to a Python worker, so that long rows come few at a
#: time. Only where the session doesn't set it.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not on their path yet, and bound
    what they are sent at once."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset, as in
    local tests, a temporary folder of this machine takes its place.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = getattr(sc, "_quillstream_dir", None)
    if own is None and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if own is None:
        own = sc._quillstream_dir = tempfile.mkdtemp(prefix="quillstream-")
        sc.setCheckpointDir(own)
    return f"file://{own}"


#: Shuffle files of a query go when its execution ends. Only for writes, whose result is
#: on disk by then; the setting is put back afterwards.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a reread and no recomputation. The
    result's ``scratch`` is its folder, for ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _on_store(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Spark has them."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def table_exists(spark: SparkSession, path: str) -> bool:
    store, at = _on_store(spark, path)
    return store.exists(at)


def discard_path(spark: SparkSession, path: str) -> None:
    store, at = _on_store(spark, path)
    store.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        discard_path(t.sparkSession, t.scratch)


#: Bytes of text that a task of a shuffle by an explicit number of partitions gets, about.
PER_TASK = 128 << 20


def partitions(texts: DataFrame, column: str = "text") -> int:
    """How many partitions a shuffle of all texts needs: the session's number, or more where the
    texts are too many for that (an explicit number is never resized at run time)."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return at_least(texts.sparkSession, size // PER_TASK + 1)


def at_least(spark: SparkSession, n: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
