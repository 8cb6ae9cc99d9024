"""The manifest of fetched repositories: one row per name with its status, replaced by key.

A change writes the whole manifest as a new version beside the last one; readers take the newest finished version, so a
writer that dies half-way leaves the last one standing. Older versions but one are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.functions.paths import safe_dir
from codekin.operators import discover, locate, verify

SCHEMA = "name string, status string, dir string, lines long, files long, score long, owner string, url string, reason string"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions, rising."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; empty where none was written yet."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/v={versions[-1]}")


def _write(spark: SparkSession, path: str, rows: DataFrame) -> None:
    versions = _versions(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/v={versions[-1] + 1 if versions else 0}")
    for old in versions[:-1]:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}")
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Rows replace those of the same name."""
    last = read(spark, path)
    new = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(last.schema[c].dataType).alias(c) for c in last.columns])
    _write(spark, path, last.join(new.select("name"), "name", "left_anti").unionByName(new))


def retry(spark: SparkSession, path: str, parts: list[str]) -> int:
    """Drop rejected rows whose reason holds one of the parts; how many were dropped."""
    m = read(spark, path)
    again = discover.requeue(m.where("status = 'rejected'"), "reason", parts).select("name")
    n = again.count()
    if n:
        _write(spark, path, m.join(again, "name", "left_anti"))
    return n


def accept(spark: SparkSession, path: str, candidates: DataFrame, files: DataFrame, rules: verify.Rules, module: locate.Module | None = None, absent: str = "could not read from remote") -> None:
    """Verify the candidates (full_name, clone_url, owner) that the manifest doesn't know and add them as accepted or rejected.

    files: (repo, relpath, text), repo being the full name. A candidate without files is rejected with the reason ``absent``.
    With a ``module``, the files below its best directory count, and the directory is noted.
    """
    new = discover.todo(candidates, read(spark, path), "name")
    new = new.groupBy(F.col("full_name").alias("name")).agg(F.min("clone_url").alias("url"), F.min("owner").alias("owner"))
    own = files.join(new.select(F.col("name").alias("repo")), "repo", "left_semi").where("relpath is not null").groupBy("repo", "relpath").agg(F.max("text").alias("text"))
    place = F.lit("")
    if module is not None:
        own, place = locate.below_best(own, module), F.coalesce("root", F.lit(""))
    roots = own.groupBy("repo").agg(F.min("root").alias("root")) if module is not None else own.select("repo", F.lit("").alias("root")).distinct()
    v = verify.verify(own.select("repo", "relpath", "text"), rules).join(roots, "repo", "left")
    folder = F.concat(safe_dir(F.col("name")), F.when(place != "", F.concat(F.lit("/"), place)).otherwise(""))
    rows = new.join(v.withColumnRenamed("repo", "name"), "name", "left").select(
        "name", F.when(F.coalesce("ok", F.lit(False)), "accepted").otherwise("rejected").alias("status"), folder.alias("dir"), "lines", "files", "score", "owner", "url",
        F.when(F.col("ok").isNull(), absent).when(~F.col("ok"), F.col("reason")).alias("reason"),
    )
    upsert(spark, path, rows)


def adopt(spark: SparkSession, path: str, files: DataFrame) -> int:
    """Add directories (dir, relpath, text) that no row names, as accepted under the name their first ``~`` parts; how many. Names that begin with an underscore are left out."""
    from codekin.scratch import materialise

    known = read(spark, path).select("dir")
    rows = verify.line_counts(files.where(F.col("dir").isNotNull() & ~F.col("dir").startswith("_")).select(F.col("dir").alias("repo"), "text")).withColumnRenamed("repo", "dir").join(known, "dir", "left_anti")
    rows = materialise(rows.select(F.regexp_replace("dir", "^([^~]*)~", "$1/").alias("name"), F.lit("accepted").alias("status"), "dir", "lines", "files"), "adopted")
    n = rows.count()
    if n:
        upsert(spark, path, rows)
    return n


def save_candidates(candidates: DataFrame, path: str) -> None:
    """Candidates as JSON lines in order of their names."""
    candidates.repartitionByRange("full_name").sortWithinPartitions("full_name").write.mode("overwrite").json(path)


def status_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("status").agg(F.count("*").alias("rows"))
