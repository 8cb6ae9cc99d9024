"""Submissions against the corpus: shared prints, containment, scores, bands and ranks.

Any number of submissions is checked at once; a submission is a key with its set of hashes. The corpus is read once and
joined on the hash; sizes come from combined counts.

Defined results: a submission without clean prints has no matches; a repository never matches itself by id; ties in a
ranking go to the lower repository id; a missing calibration value falls back to its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekin.operators.calibrate import rank_of, zscore

MIN_SAMPLE = 8  # functions below which a channel's fraction doesn't count

# Floors and multiples of the honest ceilings for the two upper bands, per channel.
BANDS = {"HIGH": {"containment": (0.30, 2.5), "ast": (0.40, 2.5), "sig": (0.55, 2.5)}, "MEDIUM": {"containment": (0.18, 1.5), "ast": (0.20, 1.5), "sig": (0.30, 1.5)}}
CEILINGS = {"p99": 1.0, "ast_p99": 0.05, "sig_p99": 0.10, "run_threshold": 250}


def shared_prints(subs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sub, repo, shared): common hashes of each submission (sub, hash) and each corpus set (repo, hash)."""
    return subs.join(sets, "hash").where("sub != repo").groupBy("sub", "repo").agg(F.count("*").alias("shared"))


def scores(subs: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sub, repo, shared, containment): containment in the smaller of both sets. sizes: (repo, n) of the sets."""
    n_sub = subs.groupBy("sub").agg(F.count("*").alias("n_sub"))
    s = shared_prints(subs, sets).join(n_sub, "sub").join(sizes.select("repo", "n"), "repo")
    return s.select("sub", "repo", "shared", (F.col("shared") / F.least("n_sub", "n")).alias("containment"))


def with_z(scored: DataFrame, null: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Adds z and p99 from a one-row null distribution (n, mean, stdev, p99); where that counts no repository, from the row of ``baseline`` (pairs, mean, stdev, max) with its max as p99."""
    one = null.select(F.col("mean").alias("m"), F.col("stdev").alias("s"), "p99", (F.col("n") if "n" in null.columns else F.lit(1)).alias("n"))
    if baseline is not None:
        one = one.crossJoin(F.broadcast(baseline.select(F.col("mean").alias("bm"), F.col("stdev").alias("bs"), F.col("max").alias("bx"))))  # one row each
        given = F.col("n") > 0
        one = one.select(*[F.when(given, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("m", "bm"), ("s", "bs"), ("p99", "bx"))])
    one = one.select("m", "s", "p99")
    return scored.crossJoin(F.broadcast(one)).withColumn("z", zscore(F.col("containment"), F.col("m"), F.col("s"))).drop("m", "s")


def self_match(owner: Column, handles: Column) -> Column:
    """Whether the owner is one of the submitter's handles, letters' case aside."""
    return F.coalesce(F.exists(handles, lambda h: F.lower(h) == F.lower(owner)), F.lit(False))


def band(columns: list[str]) -> Column:
    """SELF, HIGH, MEDIUM, LOW or NORMAL from the columns at hand; absent channels are 0, absent ceilings their defaults."""

    def col(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)

    def channel(name: str) -> Column:
        return F.when(col(f"{name}_n", 0) >= MIN_SAMPLE, col(f"{name}_frac", 0.0)).otherwise(0.0)

    value = {"containment": col("containment", 0.0), "ast": channel("ast"), "sig": channel("sig")}
    ceiling = {"containment": col("p99", CEILINGS["p99"]), "ast": col("ast_p99", CEILINGS["ast_p99"]), "sig": col("sig_p99", CEILINGS["sig_p99"])}
    out = F.when(col("self_match", False), "SELF")
    for name, limits in BANDS.items():
        hit = F.lit(False)
        for c, (floor, times) in limits.items():
            hit = hit | (value[c] >= F.greatest(F.lit(floor), F.lit(times) * ceiling[c]))
        out = out.when(hit, name)
    low = col("longest", 0) >= col("run_threshold", CEILINGS["run_threshold"])
    for c in value:
        low = low | (value[c] >= ceiling[c])
    return out.when(low, "LOW").otherwise("NORMAL")


def top_matches(scored: DataFrame, n: int = 25) -> DataFrame:
    """The n best matches of each submission with their rank from 1."""
    return rank_of(scored, ["sub"], [F.desc("containment"), F.asc("repo")]).where(F.col("rank") <= n)


def evidence_gate(ranked: DataFrame) -> DataFrame:
    """Matches worth the search for evidence: any band above NORMAL, and the six best in any case."""
    return ranked.where((F.col("verdict") != "NORMAL") | (F.col("rank") <= 6))
