"""Group identifiers from pairwise matches: alternating large-star and small-star edge rewrites.

Large-star links every larger neighbour of a node to the least of its closed neighbourhood, small-star links the node
and its smaller neighbours to that least node (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
At the fixed point every node hangs on its component's lowest id. Each rewrite is one aggregation for the minimum and
one join, so no neighbourhood is ever gathered in a task; AQE splits the rows of a hub, and the minimum is combined
before the shuffle. Every round is written to the shared scratch folder, which cuts the lineage.

Defined results: null ends, loops and repeats are dropped, direction doesn't count, null and NaN scores are no links,
nodes without a link have no group unless asked for, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.operators.hotkeys import join_counted
from codekin.scratch import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v, rewritten once."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_groups(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, group_id) of every end in ``pairs`` (a, b); group_id is the lowest id reachable."""
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct()
    edges = materialise(edges, "edges")
    for _ in range(max_rounds):
        mid = materialise(_star(edges, True), "large")
        new = materialise(_star(mid, False), "small")
        # Settled when both rewrites leave the same edges; compared by order-free fingerprints, combined before the shuffle.
        mark = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        settled = mark(edges) == mark(new)
        discard(mid)
        discard(edges)
        edges = new
        if settled:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())


def repository_groups(edges: DataFrame, repos: DataFrame, least: float = 0.15) -> DataFrame:
    """(id, group_id) of repositories in groups of two or more; links need ``containment`` and both ends in ``repos``."""
    ids = repos.select("id").where("id is not null").distinct()
    e = edges.where((F.col("containment") >= least) & ~F.isnan("containment")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return connected_groups(e)


def assign_all(edges: DataFrame, repos: DataFrame, least: float = 0.15) -> DataFrame:
    """(id, group_id, members, old_cluster): every repository; one without links is a group of its own."""
    g = repository_groups(edges, repos, least)
    r = repos.where("id is not null").select("id", F.col("cluster").alias("old_cluster")).dropDuplicates(["id"])
    every = r.join(g, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), "old_cluster")
    every = materialise(every, "assigned")
    return join_counted(every, every.groupBy("group_id").agg(F.count("*").alias("members")), ["group_id"], "members").select("id", "group_id", "old_cluster", "members")
