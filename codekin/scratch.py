"""Intermediate tables in storage that every executor can read.

A materialised table cuts the lineage: if an executor is lost later, the rows are read again instead of being computed
again from the start. The folder comes from ``spark.checkpoint.dir``. Where that is unset, a local session
(tests, a laptop) gets a temporary folder; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="codekin-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/codekin-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that no other table has."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder, in directories ``by`` columns if given, and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def clean(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that still read them must be written before."""
    jpath, fs = _file(spark, scratch_dir(spark))
    fs.delete(jpath, True)
    _KEPT.clear()


_KEPT: dict[tuple, tuple] = {}


def _file(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def kept(spark: SparkSession, inputs: list[str], name: str, build) -> DataFrame:
    """The table that ``build`` gives, written on first use; later calls of this application read it while the ``inputs`` (paths) keep their size and time."""
    state = []
    for p in inputs:
        jpath, fs = _file(spark, p)
        status = fs.getFileStatus(jpath)
        state.append((p, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(state), name)
    found = _KEPT.get(key)
    if found:
        jpath, fs = _file(spark, f"{found[0]}/_SUCCESS")
        if fs.exists(jpath):
            return spark.read.schema(found[1]).parquet(found[0])
    df = materialise(build(), name)
    _KEPT[key] = (df._scratch_path, df.schema)
    return df


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
