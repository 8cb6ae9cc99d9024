"""Clusters of similar repositories and the representative of each.

Components by label propagation with pointer jumping: every node takes the least label among its neighbours and its
label's label, until nothing changes. Each round is written to the shared scratch folder.

Defined results: a repository without links is its own cluster; the cluster is named by its lowest id; the
representative is the largest clean set, the lowest id among equals; repositories without clean prints are representatives
of no cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.operators.hotkeys import join_counted
from codekin.scratch import discard, materialise


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, cluster) for every node; edges (a, b) without direction."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = materialise(nodes.select("id").distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("further"))
        new = materialise(lower.join(jump, "low").select("id", F.least("low", "further").alias("label"), "old"), "labels")
        changed = new.where("label != old").limit(1).count()
        discard(labels)
        labels = new.select("id", "label")
        labels._scratch_path = new._scratch_path
        if not changed:
            return labels.select("id", F.col("label").alias("cluster"))
    raise RuntimeError("components didn't settle")


def representatives(sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, cluster, members, representative) of repositories with a clean set. sizes: (repo, n)."""
    c = components(sizes.select(F.col("repo").alias("id")), edges).withColumnRenamed("id", "repo").join(sizes, "repo")
    # One aggregate per cluster instead of a sort: the largest set, then the lowest id.
    best = c.groupBy("cluster").agg(F.min_by("repo", F.struct((-F.col("n")).alias("n"), "repo")).alias("keep"), F.count("*").alias("members"))
    return c.join(best, "cluster").select("repo", "cluster", "members", (F.col("repo") == F.col("keep")).cast("int").alias("representative"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(members, clusters): how many clusters there are of each size."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("clusters"))


def old_against_new(clusters: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, cluster, old_members): how many of the old run's cluster mates a repository still has."""
    old = repos.select(F.col("id").alias("repo"), F.col("cluster").alias("old_cluster"))
    both = materialise(clusters.select("repo", "cluster").join(old, "repo"), "drift")
    known = both.where("old_cluster is not null")
    counted = join_counted(known, known.groupBy("cluster", "old_cluster").agg(F.count("*").alias("old_members")), ["cluster", "old_cluster"], "old_members")
    return counted.select("repo", "cluster", "old_members").unionByName(both.where("old_cluster is null").select("repo", "cluster", F.lit(0).cast("long").alias("old_members")))
