"""Evidence behind a match: longest runs, function shapes and type signatures of gated pairs, and their honest ceilings.

Only matches that pass the gate are searched; the others keep the verdict of their containment. Submissions and corpus
keep keys of their own, so a submission may bear the name of an indexed repository.

Defined results: a side without functions has no fraction, a pair without a run has longest run 0; a channel without
sampled pairs falls back to its default ceiling; a measured ceiling of 0 is passed by any positive value, not by 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.functions.paths import language_of
from codekin.operators import calibrate, check, prints, runs, structure
from codekin.scratch import materialise

LEAST = 1e-9
MIN_STREAM = 500  # tokens
SAMPLE_REPOS = 90
MIN_ABLE = 8


def cpp_only(sources: DataFrame) -> DataFrame:
    return sources.where(language_of(F.col("relpath")) == "cpp")


def run_null(sources: DataFrame, representatives: DataFrame, least: int = MIN_STREAM) -> DataFrame:
    """One row over the longest runs of sampled pairs of representatives (repo) whose streams are longer than ``least`` tokens; the expected top is that of a search through all representatives. sources: (repo, relpath, text)."""
    # All that counts of most repositories is whether they have a token; lengths are those of the sample only.
    known = materialise(representatives.select("repo").distinct().join(prints.with_tokens(sources), "repo", "left_semi"), "known")
    picked = materialise(calibrate.draw(known, ["repo"], 42, SAMPLE_REPOS), "picked")
    tokens = prints.file_tokens(sources.join(picked, "repo", "left_semi"))
    lengths = materialise(prints.offsets(tokens).groupBy("repo").agg(F.max("total").alias("n")), "lengths")
    pairs = materialise(calibrate.pairs_of(lengths.where(F.col("n") > least), 42, 400), "sample")
    sampled = sources.join(pairs.select(F.explode(F.array("a", "b")).alias("repo")).distinct(), "repo", "left_semi")
    found = runs.maximal_runs(pairs, prints.kgrams(sampled, runs.K, neighbours=True), runs.K)
    return calibrate.run_null_stats(materialise(runs.longest_runs(pairs, found), "longest"), known.count())


def channel_null(sources: DataFrame, representatives: DataFrame, min_nodes: int = structure.MIN_NODES, min_weight: int = structure.MIN_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """The sampled pairs, and one row over their shared shapes and signatures.

    Pairs are drawn among the sampled representatives with at least four different shapes and signatures; with fewer than
    eight of those there is no pair and the channel keeps its default ceilings.
    """
    kind = sources.schema["repo"].dataType
    picked = materialise(calibrate.draw(representatives.select("repo").distinct(), ["repo"], 23, SAMPLE_REPOS), "picked")
    of = sources.join(picked, "repo", "left_semi")
    f = materialise(structure.function_shapes(of, min_nodes), "shapes").withColumn("repo", F.col("repo").cast(kind))
    g = materialise(structure.type_signatures(of, min_weight), "signatures").withColumn("repo", F.col("repo").cast(kind))
    enough = lambda x: x.select("repo", "hash").distinct().groupBy("repo").agg(F.count("*").alias("k")).where("k >= 4").select("repo")
    able = materialise(enough(f).join(enough(g), "repo"), "able")
    if able.count() < MIN_ABLE:
        able = able.limit(0)
    pairs = materialise(calibrate.pairs_of(able, 23, 500), "sample")
    ast = calibrate.channel_null_stats(materialise(structure.channel_scores(f, pairs, False), "scores"), "frac", "ast")
    return pairs, ast.crossJoin(calibrate.channel_null_stats(materialise(structure.channel_scores(g, pairs, True), "scores"), "frac", "sig"))  # one row each


def ceilings(sources: DataFrame, representatives: DataFrame, least: int = MIN_STREAM, min_nodes: int = structure.MIN_NODES, min_weight: int = structure.MIN_WEIGHT) -> DataFrame:
    """One row: run_threshold, ast_p99, sig_p99 with all statistics they come from; null where no pair could be sampled."""
    pairs, channels = channel_null(cpp_only(sources), representatives, min_nodes, min_weight)
    n = pairs.agg(F.count("*").alias("channel_pairs"))
    stats = channels.crossJoin(n)  # one row each
    stats = stats.select("channel_pairs", *[F.when(F.col("channel_pairs") > 0, F.greatest(F.col(c), F.lit(LEAST)) if c.endswith("p99") else F.col(c)).alias(c) for c in channels.columns])
    found = run_null(sources, representatives, least)
    found = found.select(*[F.col(c).alias(f"run_{c}") for c in found.columns])
    return materialise(materialise(found, "ceiling").crossJoin(stats), "ceilings")  # one row each


def channels(pairs: DataFrame, submissions: DataFrame | None, sources: DataFrame, min_nodes: int = structure.MIN_NODES, min_weight: int = structure.MIN_WEIGHT) -> DataFrame:
    """(sub, repo, longest, ast_n, ast_frac, sig_n, sig_frac) of given (sub, repo); submissions and sources: (repo, relpath, text). Without submissions these are repositories of the sources."""
    key = lambda side, c: F.concat(F.lit(side if submissions is not None else ""), F.col(c).cast("string"))
    named = materialise(pairs.select("sub", "repo", key("s:", "sub").alias("a"), key("c:", "repo").alias("b")), "gated")
    both = sources.select(key("c:", "repo").alias("repo"), "relpath", "text")
    if submissions is not None:
        both = submissions.select(key("s:", "repo").alias("repo"), "relpath", "text").unionByName(both)
    both = materialise(both.join(named.select(F.explode(F.array("a", "b")).alias("repo")).distinct(), "repo", "left_semi"), "texts")
    # Each channel is written before the next one, which keeps the plans, and what the driver holds of them, small.
    out = named.join(materialise(runs.longest_common(named, both), "longest"), ["a", "b"], "left")
    for name, found, smaller in (("ast", structure.function_shapes(cpp_only(both), min_nodes), False), ("sig", structure.type_signatures(cpp_only(both), min_weight), True)):
        scores = materialise(structure.channel_scores(materialise(found, name), named, smaller), "scores")
        out = out.join(scores.select("a", "b", F.col("n").alias(f"{name}_n"), F.col("frac").alias(f"{name}_frac")), ["a", "b"], "left")
    return out.drop("a", "b")


def judged(ranked: DataFrame, submissions: DataFrame | None, sources: DataFrame, null: DataFrame, min_nodes: int = structure.MIN_NODES, min_weight: int = structure.MIN_WEIGHT) -> DataFrame:
    """Ranked matches with the channels of the gated ones and the verdict over all channels. ranked: (sub, repo, rank, verdict, ...); null: as of ceilings."""
    ranked = materialise(ranked, "ranked")
    found = channels(check.evidence_gate(ranked), submissions, sources, min_nodes, min_weight)
    out = ranked.join(found, ["sub", "repo"], "left").crossJoin(F.broadcast(null.select("run_threshold", "ast_p99", "sig_p99")))  # one row
    return out.withColumn("verdict", check.band(out.columns))
