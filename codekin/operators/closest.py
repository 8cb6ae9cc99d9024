"""The closest sets of every set, among all pairs that share a hash, without any cap.

Sets are cut into blocks by their id; each block meets each block, and posting lists are added up in arrays. So a hash of
very many repositories makes no row for a pair, and what leaves a meeting of two blocks is linear in them: the n best of
each set, and a forest in place of the edges.

Defined results: ties go to the lower id; a set never meets itself; sets that share nothing with others are left out. Ids
and hashes are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.operators.calibrate import rank_of
from codekin.operators.index import Buckets
from codekin.scratch import materialise

BLOCK_ROWS = 4_000_000  # (repo, hash) rows of a block, which one worker holds
AT_ONCE = 4_000_000  # entries of posting lists added up at once
NAMES = ["a", "b", "shared", "containment", "link"]
KINDS = [np.int64, np.int64, np.int64, np.float64, bool]


def _union(parent: np.ndarray, nodes: np.ndarray) -> None:
    """Joins the trees that hold ``nodes`` under the least of their roots."""
    roots = parent[nodes]
    while (parent[roots] != roots).any():
        roots = parent[roots]
    parent[roots] = parent[nodes] = roots.min()


def _meet(own: pa.Table, others: pa.Table, n: int, least: float | None) -> list[tuple]:
    """Columns of NAMES, in parts, for the sets of one block against those of another; both (repo, n, hash)."""
    repo, size, hashes = (others.column(c).to_numpy() for c in ("repo", "n", "hash"))
    ids, at = np.unique(repo, return_inverse=True)
    sizes = np.zeros(len(ids), np.int64)
    sizes[at] = size
    order = np.argsort(hashes, kind="stable")
    posted = at[order].astype(np.int32)
    known, starts = np.unique(hashes[order], return_index=True)
    lengths = np.diff(np.append(starts, len(posted)))

    repo, size, hashes = (own.column(c).to_numpy() for c in ("repo", "n", "hash"))
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    met = np.flatnonzero(known[place] == hashes)
    met = met[np.argsort(repo[met], kind="stable")]
    repo, size, place = repo[met], size[met], place[met]
    cuts = np.append(np.unique(repo, return_index=True)[1], len(repo))
    nodes = np.union1d(ids, repo)
    parent, node_of = np.arange(len(nodes)), np.searchsorted(nodes, ids)
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        counts = np.zeros(len(ids), np.int64)
        lists = place[lo:hi]
        for part in np.split(lists, np.flatnonzero(np.diff(np.cumsum(lengths[lists]) // AT_ONCE)) + 1):
            k = lengths[part]
            counts += np.bincount(posted[np.repeat(starts[part] - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=len(ids))
        found = np.flatnonzero(counts)
        found = found[ids[found] != repo[lo]]
        score = counts[found] / np.minimum(size[lo], sizes[found])
        if least is not None and (near := score >= least).any():
            _union(parent, np.append(node_of[found[near]], np.searchsorted(nodes, repo[lo])))
        if len(found) > n:
            nth = np.partition(score, len(score) - n)[len(score) - n]
            above = np.flatnonzero(score > nth)
            best = np.append(above, np.flatnonzero(score == nth)[: n - len(above)])
            found, score = found[best], score[best]
        out.append((np.full(len(found), repo[lo]), ids[found], counts[found], score, np.zeros(len(found), bool)))
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return [*out, (nodes[parent[linked]], nodes[linked], np.zeros(len(linked)), np.zeros(len(linked)), np.ones(len(linked), bool))]


def closest(b: Buckets, n: int, least: float | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(a, b, shared, containment): for every set a the n others of highest containment; and (a, b): links with the same components as all pairs of at least ``least``."""
    held = b.narrow.unionByName(b.wide.select("repo", "hash")).join(b.sizes.select("repo", "n"), "repo")
    held = materialise(held.select(F.col("repo").cast("long").alias("repo"), "n", F.col("hash").cast("long").alias("hash")), "held")
    k = max(1, -(-held.count() // block_rows))
    rows = max(k, -(-held.sparkSession.sparkContext.defaultParallelism // k))  # as many meetings as cores
    block = lambda k: F.pmod(F.xxhash64("repo"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = held.withColumns({"row": block(rows), "col": every(k)}).groupBy("row", "col")
    right = held.withColumns({"col": block(k), "row": every(rows)}).groupBy("row", "col")

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        parts = _meet(own, others, n, least) if len(own) and len(others) else []
        return pa.table({c: np.concatenate([np.zeros(0, t), *[p[i] for p in parts]]).astype(t) for i, (c, t) in enumerate(zip(NAMES, KINDS, strict=True))})

    found = materialise(left.cogroup(right).applyInArrow(run, "a long, b long, shared long, containment double, link boolean"), "closest")
    best = rank_of(found.where("not link"), ["a"], [F.desc("containment"), F.asc("b")]).where(F.col("rank") <= n)
    return best.select("a", "b", "shared", "containment"), found.where("link").select("a", "b")
