"""The fingerprint index: document frequencies, boilerplate, clean sets, co-occurring pairs and their containment.

Pairs come from an inverted index whose buckets above ``cap`` repositories are left out of the search (they are residual
boilerplate) unless ``whole`` is asked for, while the containment counts the full intersection. The capped part is counted in the pair join itself;
hashes of larger buckets are few and are added for pairs that can still reach the asked containment.

Skew: (repo, hash) is made unique with combining before any join, a hash of very many repositories is never gathered to be
counted, a bucket in the join holds at most ``cap`` rows.

Defined results: null hashes and repositories are left aside, repeated prints count once, sets without clean prints
have no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.operators.hotkeys import HOT_SHARE, heavy_keys, with_key_counts
from codekin.scratch import materialise

CAP = 200


def repo_sets(prints: DataFrame) -> DataFrame:
    """(repo, hash), distinct."""
    return prints.where("hash is not null and repo is not null").select("repo", "hash").distinct()


def document_frequency(prints: DataFrame) -> DataFrame:
    """(hash, df): repositories per hash."""
    return repo_sets(prints).groupBy("hash").agg(F.count("*").alias("df"))


def boilerplate(prints: DataFrame, repos: DataFrame, share: float = 0.25) -> DataFrame:
    """(hash): hashes in at least a share of all indexed repositories, those without prints included."""
    n = repos.agg(F.count("*").alias("n"))
    return document_frequency(prints).crossJoin(F.broadcast(n)).where(F.col("df") >= F.lit(share) * F.col("n")).select("hash")


def clean_sets(prints: DataFrame, boiler: DataFrame) -> DataFrame:
    """(repo, hash) without boilerplate."""
    return repo_sets(prints).join(boiler.select("hash").where("hash is not null").distinct(), "hash", "left_anti").select("repo", "hash")


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("repo").agg(F.count("*").alias("n"))


@dataclass
class Buckets:
    """Clean sets split by bucket size; hashes of one repository only count for the set's size."""

    narrow: DataFrame  # repo, hash, n: buckets of 2 to cap repositories
    wide: DataFrame  # repo, hash, df: larger buckets
    sizes: DataFrame  # repo, n, wide: size of the set, and its number of hashes in larger buckets


def buckets(sets: DataFrame, cap: int = CAP) -> Buckets:
    """Bucket sizes by one shuffle on the hash; what can't pair is folded into counts at once."""
    df = with_key_counts(sets, "hash", heavy_keys(sets, "hash", HOT_SHARE))
    held = materialise(df.groupBy("repo", F.when(F.col("df") > 1, F.col("hash")).alias("hash"), "df").agg(F.count("*").alias("k")), "buckets")
    sizes = materialise(held.groupBy("repo").agg(F.sum("k").alias("n"), F.count_if(F.col("df") > cap).alias("wide")), "sizes")
    narrow = held.where((F.col("df") > 1) & (F.col("df") <= cap)).select("repo", "hash")
    wide = held.where((F.col("df") > 1) & (F.col("df") > cap)).select("repo", "hash", "df")
    return Buckets(narrow, wide, sizes)


def candidate_pairs(b: Buckets) -> DataFrame:
    """(a, b, k): pairs sharing a hash in some bucket of at most cap repositories, and how many such hashes."""
    left = b.narrow.select(F.col("repo").alias("a"), "hash")
    right = b.narrow.select(F.col("repo").alias("b"), "hash")
    return left.join(right, "hash").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))


def wide_pairs(b: Buckets, least: float) -> DataFrame:
    """(a, b), a < b: every pair that shares no narrow hash and can reach ``least``, and others; found in the larger buckets.

    What such a pair shares is all wide, so the smaller set has one of the shared hashes among its wide ones without the
    need - 1 most common; only those are looked up. Equal sets take part once, through the lowest of them.
    """
    own = b.wide.join(b.sizes, "repo")
    n_wide = F.col("wide")
    # Equal sets have equal wide and narrow parts; hashes of a single repository are in neither, so n tells those apart.
    parts = b.wide.select("repo", "hash").unionByName(b.narrow.select("repo", "hash")).join(b.sizes.where(n_wide > 0).select("repo", "n"), "repo")
    marked = parts.groupBy("repo", "n").agg(F.count("*").alias("held"), F.md5(F.concat_ws(",", F.sort_array(F.collect_list(F.col("hash").cast("string"))))).alias("mark"))
    key = F.when(F.col("held") == F.col("n"), F.col("mark")).otherwise(F.concat(F.lit("repo "), F.col("repo").cast("string")))
    marked = materialise(marked.select("repo", key.alias("key")), "marked")
    members = materialise(marked.join(marked.groupBy("key").agg(F.min("repo").alias("rep")), "key").select("repo", "rep"), "members")
    own = own.join(members.where("repo = rep").select("repo"), "repo", "left_semi")
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("df", "hash"))
    probes = own.where(n_wide >= need).withColumn("place", place).where(F.col("place") <= n_wide - need + 1).select(F.col("repo").alias("x"), F.col("n").alias("nx"), "hash")
    held = own.select(F.col("repo").alias("y"), F.col("n").alias("ny"), "hash")
    met = probes.join(held, "hash").where((F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    copies = members.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1")
    met = met.unionByName(copies.select(F.col("rep").alias("x"), F.col("rep").alias("y")))
    both = met.join(members.toDF("p", "x"), "x").join(members.toDF("q", "y"), "y").where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def pair_containment(b: Buckets, least: float = 0.0, whole: bool = False) -> DataFrame:
    """(a, b, shared, containment) of the co-occurring pairs with at least ``least``; shared is the full intersection.

    ``whole`` also finds the pairs that share hashes of larger buckets only; without it they are left out, as the cap asks.
    """
    sa = b.sizes.select(F.col("repo").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    sb = b.sizes.select(F.col("repo").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    found = candidate_pairs(b)
    if whole:
        found = materialise(found, "narrow")
        found = found.unionByName(wide_pairs(b, least).join(found, ["a", "b"], "left_anti").withColumn("k", F.lit(0).cast("long")))
    pairs = found.join(sa, "a").join(sb, "b").withColumn("low", F.least("na", "nb"))
    pairs = pairs.where(F.col("k") + F.least("wa", "wb") >= F.lit(least) * F.col("low"))
    if least > 0 or whole:
        pairs = materialise(pairs, "pairs")
    wide_a = b.wide.select(F.col("repo").alias("a"), "hash")
    wide_b = b.wide.select(F.col("repo").alias("b"), "hash")
    more = pairs.where("wa > 0 and wb > 0").select("a", "b").join(wide_a, "a").join(wide_b, ["b", "hash"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("more"))
    shared = (F.col("k") + F.coalesce("more", F.lit(0))).alias("shared")
    out = pairs.join(more, ["a", "b"], "left").select("a", "b", shared, "low")
    return out.withColumn("containment", F.col("shared") / F.col("low")).where(F.col("containment") >= least).drop("low")


def similarity_edges(sets: DataFrame, least: float = 0.15, cap: int = CAP, whole: bool = False) -> DataFrame:
    """(a, b, shared, containment) of pairs above the honest ceiling."""
    return pair_containment(buckets(sets, cap), least, whole)


def partners(sets: DataFrame, cap: int = CAP) -> DataFrame:
    """(repo, partners): how many repositories each one co-occurs with."""
    p = candidate_pairs(buckets(sets, cap))
    return p.select(F.col("a").alias("repo")).unionByName(p.select(F.col("b").alias("repo"))).groupBy("repo").agg(F.count("*").alias("partners"))
