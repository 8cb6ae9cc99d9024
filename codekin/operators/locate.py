"""Finding a sub-project's directory in a repository's list of paths.

Directories come from path patterns and are confirmed by the file stems they hold. Everything works on the listing.

Defined results: null paths are left aside; the first matching pattern counts; among equal scores the first directory
in path order wins; without a directory the whole repository is scored; a repository that fails as well has no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.functions.paths import SUFFIXES, any_suffix, normal_path, stem_of


@dataclass
class Module:
    """What the asked sub-project looks like."""

    patterns: list[str]
    required: list[str]
    optional: list[str] = field(default_factory=list)
    forbidden: list[str] = field(default_factory=list)
    threshold: int | None = None
    min_files: int = 2
    suffixes: list[str] = field(default_factory=lambda: SUFFIXES["cpp"])


def candidate_dirs(listing: DataFrame, patterns: list[str]) -> DataFrame:
    """(repo, root, path): the directory that ends with the first pattern's match. listing: (repo, path)."""
    up = F.regexp_replace("path", "/?[^/]*$", "")
    root = None
    for pattern in patterns:
        # Up to the first slash at or behind the end of the first match.
        reached = F.regexp_extract("path", rf"^.*?(?:{pattern})(?:(?<=/)|[^/]*/)", 0)
        one = F.when(F.col("path").rlike(pattern), F.when(reached != "", F.regexp_replace(reached, "/$", "")).otherwise(up))
        root = one if root is None else F.coalesce(root, one)
    paths = listing.where("path is not null").select("repo", normal_path(F.col("path")).alias("path"))
    return paths.select("repo", F.explode(F.array(F.struct(root.alias("root"), "path"))).alias("d")).select("repo", "d.root", "d.path").where("root is not null")


def score_dirs(files: DataFrame, module: Module) -> DataFrame:
    """(repo, root, hits, supporting, sources, score) of each directory (repo, root, path); 0 where it doesn't qualify."""
    files = files.select("repo", "root", "path", stem_of(F.col("path")).alias("stem"))
    stem = F.col("stem")
    count = lambda names: F.coalesce(sum((F.max(F.coalesce(stem == n, F.lit(False)).cast("int")) for n in names[1:]), F.max(F.coalesce(stem == names[0], F.lit(False)).cast("int"))), F.lit(0)) if names else F.lit(0)
    need = module.threshold if module.threshold is not None else max(1, len(module.required) // 2)
    s = files.groupBy("repo", "root").agg(count(module.required).alias("hits"), count(module.optional).alias("supporting"), count(module.forbidden).alias("foreign"), F.count_if(any_suffix(F.col("path"), module.suffixes)).alias("sources"))
    ok = (F.col("hits") >= need) & (F.col("foreign") == 0) & (F.col("sources") >= module.min_files)
    return s.select("repo", "root", "hits", "supporting", "sources", F.when(ok, F.col("hits") * 3 + F.col("supporting")).otherwise(0).alias("score"))


def locate(listing: DataFrame, module: Module) -> DataFrame:
    """(repo, root, score): the best directory, or the repository itself as an empty root."""
    best = score_dirs(candidate_dirs(listing, module.patterns), module).where("score > 0").groupBy("repo").agg(F.min_by(F.struct("root", "score"), F.struct((-F.col("score")).alias("s"), "root")).alias("best"))
    whole = score_dirs(listing.where("path is not null").select("repo", F.lit("").alias("root"), normal_path(F.col("path")).alias("path")), module).where("score > 0")
    return whole.select("repo", F.col("score").alias("whole")).join(best, "repo", "full").select("repo", F.coalesce("best.root", F.lit("")).alias("root"), F.coalesce("best.score", "whole").alias("score"))


def all_dirs(listing: DataFrame, module: Module) -> DataFrame:
    """(repo, root, score, rank): every qualifying directory, the best first; ties go to the first path."""
    found = score_dirs(candidate_dirs(listing, module.patterns), module).where("score > 0").select("repo", "root", "score")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "root")))


def below_best(files: DataFrame, module: Module) -> DataFrame:
    """(repo, relpath, text, root): files of the best directory with paths below it; all files where none qualifies. files: (repo, relpath, text)."""
    best = locate(files.select("repo", F.col("relpath").alias("path")), module).select("repo", "root")
    placed = files.join(best, "repo", "left").withColumn("root", F.coalesce("root", F.lit("")))
    path = normal_path(F.col("relpath"))
    inside = (F.col("root") == "") | path.startswith(F.concat("root", F.lit("/")))
    cut = F.when(F.col("root") == "", F.col("relpath")).otherwise(F.substring(path, F.length("root") + 2, F.length(path)))
    return placed.where(inside).select("repo", cut.alias("relpath"), "text", "root")
