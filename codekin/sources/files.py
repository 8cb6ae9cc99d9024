"""Source trees on shared storage: listing first, contents only of wanted files.

Spark's readers never list names that begin with a dot or an underscore.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.functions.paths import NAMES, SUFFIXES, language_of, selected

SCHEMA = "repo string, relpath string, lang string, text string"


def _placed(files: DataFrame, root: str) -> DataFrame:
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.withColumn("below", below).withColumns({"repo": F.substring_index("below", "/", 1), "relpath": F.expr("substr(below, instr(below, '/') + 1)")})


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(repo, relpath, length, path): every file below root/repo/; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return _placed(files, root).select("repo", "relpath", "length", "path")


def _any_case(name: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def _glob(suffixes: list[str] | None, languages: list[str] | None) -> str:
    """A pattern of file names that lets through every name the selection can want."""
    if not languages:
        return "{" + ",".join(f"*{s}" for s in suffixes or SUFFIXES["cpp"]) + "}"
    names = [_any_case(n) for n, lang in NAMES.items() if lang in languages]
    names += [f"*{_any_case(s)}" for lang in languages for s in SUFFIXES.get(lang, [])]
    names += [p for lang, ps in {"dockerfile": ["dockerfile*", "*.dockerfile"], "make": ["makefile*"]}.items() if lang in languages for p in map(_any_case, ps)]
    return "{" + ",".join(names) + "}"


def source_files(spark: SparkSession, root: str, suffixes: list[str] | None = None, languages: list[str] | None = None, excluded: tuple[str, ...] = (".git",)) -> DataFrame:
    """(repo, relpath, lang, text) of wanted files; bytes that are no UTF-8 are left out.

    The listing decides first: only directories that hold a wanted file are read, and in them only files whose names match,
    so nothing is opened in an excluded directory or under another name. Spark's file index holds every listed file on the
    driver in any case; the directories are fewer than that.
    """
    wanted = listing(spark, root).where(selected(F.col("relpath"), suffixes, languages, list(excluded)))
    folders = [r.folder for r in wanted.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in sorted(folders)]
    files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffixes, languages)).load(paths)
    found = _placed(files, root).where(selected(F.col("relpath"), suffixes, languages, list(excluded)))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return found.select("repo", "relpath", language_of(F.col("relpath")).alias("lang"), text.alias("text"))
