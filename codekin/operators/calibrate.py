"""Null distributions: what honest repositories score against each other.

Percentiles are values at 0-based rank floor(p * n) of the ascending values. They are found by refining value
histograms, so values are never sorted in one task; ratios become integers in an order-preserving way for that.

Defined results: without pairs or repositories the statistics are 0 and n is 0; a repository without partners has best
match 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def ranked_values(df: DataFrame, value: str, picks: dict[str, float]) -> DataFrame:
    """One row: for each name the value at rank floor(p * n), n - 1 at most; values in [0, 1] or integers below 2**22.

    All ranks are refined together: each round counts values per bucket of the rank's interval, combined in each task, and
    one row per percentile comes back.
    """
    spark = df.sparkSession
    scaled = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value")).withColumn("x", (F.col("value") * F.lit(float(1 << 40))).cast("long"))
    n, low, high = scaled.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return spark.range(1).select(*[F.lit(0.0).alias(name) for name in picks])
    ps = sorted(set(picks.values()))
    state = [(min(math.floor(p * n), n - 1), low, high) for p in ps]
    while any(hi > lo for _, lo, hi in state):
        widths = [-(-(hi - lo + 1) // BUCKETS) for _, lo, hi in state]
        tags = [F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("i"), F.round((F.col("x") - lo - F.pmod(F.col("x") - lo, F.lit(w))) / w).cast("long").alias("b"))) for i, ((_, lo, hi), w) in enumerate(zip(state, widths, strict=True))]
        hist = scaled.select(F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())).alias("t")).groupBy("t.i", "t.b").agg(F.count("*").alias("n"))
        upto = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("b")))  # at most BUCKETS rows a percentile
        rank = F.element_at(F.array(*[F.lit(r) for r, _, _ in state]), F.col("i") + 1)
        for r in upto.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)).collect():
            k, lo, hi = state[r.i]
            at = lo + r.b * widths[r.i]
            state[r.i] = (k - (r.upto - r.n), at, min(hi, at + widths[r.i] - 1))
    # Equal integers may hold unequal ratios only beyond 2**-40; the least of them is reported.
    at = dict(zip(ps, (lo for _, lo, _ in state), strict=True))
    found = {r.x: r.v for r in scaled.where(F.col("x").isin(sorted(set(at.values())))).groupBy("x").agg(F.min("value").alias("v")).collect()}
    return spark.range(1).select(*[F.lit(found[at[p]]).alias(name) for name, p in picks.items()])


def baseline_stats(pairs: DataFrame) -> DataFrame:
    """One row over co-occurring pairs: pairs, mean, stdev (population; 0 for fewer than two), max, p95."""
    stats = pairs.agg(
        F.count("*").alias("pairs"), F.round(F.coalesce(F.avg("containment"), F.lit(0.0)), 9).alias("mean"), F.round(F.coalesce(F.stddev_pop("containment"), F.lit(0.0)), 9).alias("stdev"), F.coalesce(F.max("containment"), F.lit(0.0)).alias("max")
    )
    return stats.crossJoin(ranked_values(pairs, "containment", {"p95": 0.95}))  # one row each


def top_match(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(repo, best): the highest containment of each repository in ``members`` (repo), 0 without partners."""
    both = pairs.select(F.col("a").alias("repo"), "containment").unionByName(pairs.select(F.col("b").alias("repo"), "containment"))
    best = both.groupBy("repo").agg(F.max("containment").alias("best"))
    return members.select("repo").join(best, "repo", "left").select("repo", F.coalesce("best", F.lit(0.0)).alias("best"))


def top_match_stats(best: DataFrame) -> DataFrame:
    """One row: n, mean, stdev, p50, p95, p99, max of the best matches."""
    stats = best.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("best"), F.lit(0.0)), 9).alias("mean"), F.round(F.coalesce(F.stddev_pop("best"), F.lit(0.0)), 9).alias("stdev"), F.coalesce(F.max("best"), F.lit(0.0)).alias("max"))
    return stats.crossJoin(ranked_values(best, "best", {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


def draw(df: DataFrame, cols: list[str], seed: int, n: int) -> DataFrame:
    """A fixed sample of n rows: the first by the md5 of the seed and the key columns."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return df.withColumn("mark", mark).orderBy("mark", *cols).limit(n).drop("mark")


def sampled_pairs(members: DataFrame, seed: int, n_members: int, n_pairs: int) -> DataFrame:
    """(a, b), a < b: a fixed sample of pairs among a fixed sample of members (repo)."""
    return pairs_of(draw(members.select("repo"), ["repo"], seed, n_members), seed, n_pairs)


def pairs_of(members: DataFrame, seed: int, n_pairs: int) -> DataFrame:
    """(a, b), a < b: a fixed sample of the pairs among ``members`` (repo), a sample itself."""
    m = members.select("repo")
    pairs = m.select(F.col("repo").alias("a"), F.lit(1).alias("one")).join(m.select(F.col("repo").alias("b"), F.lit(1).alias("one")), "one").where("a < b").select("a", "b")
    return draw(pairs, ["a", "b"], seed, n_pairs)


def run_null_stats(longest: DataFrame, n_corpus: int) -> DataFrame:
    """One row over sampled longest runs: pairs, median, p95, p99, max, the expected top of n_corpus draws, and the threshold."""
    q = max(0.0, 1.0 - 1.0 / max(n_corpus, 2))
    n = longest.agg(F.count("*").alias("pairs"), F.coalesce(F.max("longest"), F.lit(0)).cast("double").alias("max"))
    picks = ranked_values(longest, "longest", {"median": 0.5, "p95": 0.95, "p99": 0.99, "expected_top": q})
    low = F.greatest(F.floor(F.col("expected_top") * 1.2), F.lit(250))
    high = F.greatest(F.floor(F.col("p99") * 2), F.lit(400))
    return n.crossJoin(picks).withColumn("threshold", F.least(low, high).cast("long"))


def channel_null_stats(scores: DataFrame, value: str, prefix: str) -> DataFrame:
    """One row for an evidence channel: mean, p95, p99, max of the sampled pairs' shared fractions."""
    stats = scores.agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 9).alias(f"{prefix}_mean"), F.coalesce(F.max(value), F.lit(0.0)).alias(f"{prefix}_max"))
    return stats.crossJoin(ranked_values(scores, value, {f"{prefix}_p95": 0.95, f"{prefix}_p99": 0.99}))


def zscore(value: Column, mean: Column, stdev: Column) -> Column:
    return (value - mean) / F.coalesce(F.nullif(stdev, F.lit(0.0)), F.lit(1e-9))


def rank_of(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
