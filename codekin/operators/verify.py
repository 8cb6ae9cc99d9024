"""Does a repository hold the project that is asked for: counts, tokens, and build-file names.

Every file is looked at on its own and the findings are combined per repository, so no repository's text is ever put
together. Defined results: null texts count as files without lines; an empty rule never rejects; the first failing rule
names the reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rules:
    """What a project must look like."""

    min_files: int = 1
    min_lines: int = 0
    reject: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    required_threshold: int = 0
    required_weight: int = 1
    optional: list[str] = field(default_factory=list)
    optional_weight: int = 1
    target_names: list[str] = field(default_factory=list)
    target_weight: int = 1
    min_score: int = 1


def has_word(text: Column, word: str) -> Column:
    """The word between word borders, letters' case counting."""
    return F.coalesce(text.rlike(rf"\b{re.escape(word)}\b"), F.lit(False))


def line_counts(files: DataFrame) -> DataFrame:
    """(repo, files, lines): line feeds in all files, so an open last line doesn't count."""
    feeds = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return files.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.coalesce(feeds, F.lit(0))).cast("long").alias("lines"))


def token_hits(files: DataFrame, words: list[str]) -> DataFrame:
    """(repo, word, files): in how many files of a repository each word stands; words that stand in none are absent."""
    pairs = F.explode(F.filter(F.array(*[F.when(has_word(F.col("text"), w), F.lit(w)) for w in words]), lambda w: w.isNotNull()))
    return files.select("repo", pairs.alias("word")).groupBy("repo", "word").agg(F.count("*").alias("files"))


def build_name(text: Column) -> Column:
    """The value of the first NAME assignment of a build file; null without one."""
    value = F.regexp_extract(text, r"(?mi)^[ \t]*NAME[ \t]*[:?+]?=[ \t]*(.+?)[ \t\r]*$", 1)
    return F.nullif(value, F.lit(""))


def verify(files: DataFrame, rules: Rules, build_files: DataFrame | None = None) -> DataFrame:
    """(repo, ok, score, files, lines, found, supporting, reason). build_files: (repo, path, text)."""
    text = F.col("text")
    seen = lambda ws: [F.max(has_word(text, w).cast("int")) for w in ws]
    total = lambda cols: F.coalesce(sum(cols[1:], cols[0]), F.lit(0)) if cols else F.lit(0)
    rejected = [F.max(F.coalesce(F.contains(text, F.lit(w)), F.lit(False))) for w in rules.reject if w]
    first_reject = F.coalesce(*[F.when(c, F.lit(w)) for c, w in zip(rejected, [w for w in rules.reject if w], strict=True)], F.lit(None)) if rejected else F.lit(None).cast("string")
    feeds = F.sum(F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))).cast("long")
    r = files.groupBy("repo").agg(F.count("*").alias("files"), feeds.alias("lines"), total(seen(rules.required)).alias("found"), total(seen(rules.optional)).alias("supporting"), first_reject.cast("string").alias("rejected"))
    named = F.lit(0)
    if build_files is not None:
        depth = F.size(F.split("path", "/"))
        first = build_files.where(depth <= 3).groupBy("repo").agg(F.min_by("text", F.struct(depth.alias("d"), F.col("path").alias("p"))).alias("build_text"))
        r = r.join(first, "repo", "left")
        named = F.when(build_name(F.col("build_text")).isin(rules.target_names), rules.target_weight).otherwise(0)
    score = F.when(F.col("found") > 0, rules.required_weight).otherwise(0) + F.when(F.col("supporting") > 0, rules.optional_weight).otherwise(0) + named
    early = (
        F.when(F.col("files") < rules.min_files, "too few source files")
        .when(F.col("lines") < rules.min_lines, "too few lines")
        .when(F.col("rejected").isNotNull(), F.concat(F.lit("reject token "), F.col("rejected")))
        .when(F.col("found") < rules.required_threshold, F.concat(F.lit("only "), F.col("found").cast("string"), F.lit(f"/{rules.required_threshold} required tokens")))
    )
    r = r.withColumn("early", early).withColumn("score", F.when(F.col("early").isNotNull(), 0).otherwise(score))
    ok = F.col("early").isNull() & (F.col("score") >= rules.min_score)
    reason = F.coalesce("early", F.when(~ok, F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(f" < {rules.min_score}"))), F.lit(""))
    return r.select("repo", ok.alias("ok"), "score", "files", "lines", "found", "supporting", reason.alias("reason"))
