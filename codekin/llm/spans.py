"""Long exact spans shared between records.

A record is one (repo, file) with its hashes in order of ``pos``. Every window of ``window`` consecutive hashes gets a
Rabin-Karp hash; a window is shared when its hash occurs in two different records, and shared windows that overlap or
touch merge into maximal intervals.

Plan: one shuffle brings the prints of a (repo, file, block) together in order, Arrow batches compute the window hashes
with prefix sums, one shuffle groups equal windows, one small shuffle merges intervals.

Skew: files are cut into blocks of 65,536 token positions, so a giant file spreads over many tasks; windows over a
block border come from the 16 prints on each side of it. Equal windows are combined before the shuffle: overlapping
repeats in one file become one interval, and of a window that a chunk holds in several records only the first and the
last row go to the group of its hash, as the others are already known to be shared and travel under scattered keys.
A hash therefore receives at most two rows per chunk from different records.

Defined results: rows with a null hash, repo, file or pos are left aside; exact repeats count once; rows that differ
only in line count once; hashes at one pos are read in ascending order; records shorter than the window have no case;
an empty table gives an empty result. Window hashes have 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.scratch import materialise

BLOCK_BITS = 16
CHUNK_ROWS = 1_000_000
BROADCAST_FILES = 100_000
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
WINDOW_SCHEMA = "w long, v int, repo long, fh long, a int, b int, nx int, direct boolean"
_ARROW_WINDOWS = pa.schema([("w", pa.int64()), ("v", pa.int32()), ("repo", pa.int64()), ("fh", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("nx", pa.int32()), ("direct", pa.bool_())])


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling_hashes(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each window; prefix sums make the cost independent of the window's length."""
    n = len(values)
    if n < window:
        return np.empty(0, np.uint64)
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * inverse[:n], dtype=np.uint64, out=prefix[1:])
    return (prefix[window:] - prefix[: n - window + 1]) * powers[window - 1 : n]


def _emit(repo, fh, seg, pos, hashes, window: int, closed: bool) -> tuple[pa.RecordBatch | None, int]:
    """Combined windows of one chunk; also the row from which the next chunk has to continue."""
    n = len(pos)
    keep_from = n
    if not closed and n:
        start_last = int(np.searchsorted(seg, seg[-1]))
        keep_from = max(start_last, n - window)
    starts = np.arange(max(0, n - window + 1))
    starts = starts[seg[starts] == seg[starts + window - 1]]
    if not closed:
        starts = starts[starts < keep_from]
    if not len(starts):
        return None, keep_from
    mixed = _mix(hashes.view(np.uint64))
    wa = rolling_hashes(mixed, window, BASE_A)[starts]
    wb = rolling_hashes(mixed, window, BASE_B)[starts]
    w, v = _mix(wa), (_mix(wb) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    ends = starts + window - 1
    following = np.minimum(ends + 1, n - 1)
    nx = np.where((ends + 1 < n) & (seg[following] == seg[ends]), pos[following], pos[ends])

    order = np.lexsort((starts, v, w))
    s, e, nx, w, v = starts[order], ends[order], nx[order], w[order], v[order]
    same = np.zeros(len(s), bool)
    same[1:] = (w[1:] == w[:-1]) & (v[1:] == v[:-1])
    chained = same.copy()
    chained[1:] &= (seg[s[1:]] == seg[s[:-1]]) & (s[1:] <= s[:-1] + window)
    first = np.flatnonzero(~chained)
    last = np.append(first[1:], len(s)) - 1
    s, e, nx, w, v = s[first], e[last], nx[last], w[first], v[first]
    group_first = np.flatnonzero(~same[first])
    group_last = np.append(group_first[1:], len(s)) - 1
    many = (repo[s[group_first]] != repo[s[group_last]]) | (fh[s[group_first]] != fh[s[group_last]])
    direct = np.repeat(many, group_last - group_first + 1)
    direct[group_first] = False
    direct[group_last] = False
    key = w.view(np.int64).copy()
    scattered = _mix((s[direct].astype(np.uint64) << np.uint64(20)) ^ w[direct] ^ fh[s[direct]].view(np.uint64))
    key[direct] = scattered.view(np.int64)
    batch = pa.record_batch([pa.array(key), pa.array(v), pa.array(repo[s]), pa.array(fh[s]), pa.array(pos[s].astype(np.int32)), pa.array(pos[e].astype(np.int32)), pa.array(nx.astype(np.int32)), pa.array(direct)], schema=_ARROW_WINDOWS)
    return batch, keep_from


def _windows(window: int, by_block: bool):
    """Window rows of batches sorted by (repo, fh, blk, pos, hash); ``gap`` marks a row that doesn't follow its predecessor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        np.seterr(over="ignore")

        def flush(closed: bool):
            nonlocal held, rows
            repo, fh, blk, pos, hashes, gap = (np.concatenate(x) for x in zip(*held, strict=True))
            moved = np.ones(len(pos), bool)
            moved[1:] = (repo[1:] != repo[:-1]) | (fh[1:] != fh[:-1])
            repeated = np.zeros(len(pos), bool)
            repeated[1:] = ~moved[1:] & (pos[1:] == pos[:-1]) & (hashes[1:] == hashes[:-1])
            if by_block:
                moved[1:] |= blk[1:] != blk[:-1]
            moved |= gap.astype(bool)
            keep = ~repeated
            seg = np.cumsum(moved)[keep]
            cols = [x[keep] for x in (repo, fh, blk, pos, hashes, gap)]
            batch, start = _emit(cols[0], cols[1], seg, cols[3], cols[4], window, closed)
            held = [[x[start:] for x in cols]]
            rows = len(held[0][0])
            return batch

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in ("repo", "fh", "blk", "pos", "hash")]
            gap = b.column("gap").to_numpy(zero_copy_only=False).astype(np.int8) if "gap" in b.schema.names else np.zeros(b.num_rows, np.int8)
            held.append([*cols, gap])
            rows += b.num_rows
            if rows >= CHUNK_ROWS:
                out = flush(False)
                if out is not None:
                    yield out
        if rows:
            out = flush(True)
            if out is not None:
                yield out

    return run


def _border_rows(window: int):
    """First and last ``window`` prints of each block; gap is set where prints between them are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        head: pd.DataFrame | None = None
        tail: pd.DataFrame | None = None
        count = 0
        key: tuple | None = None

        def done():
            part = head if count <= window else pd.concat([head, tail.tail(min(window, count - window)).assign(gap=lambda t: [int(count > 2 * window)] + [0] * (len(t) - 1))])
            return pa.RecordBatch.from_pandas(part[["repo", "fh", "blk", "pos", "hash", "gap"]].astype({"gap": "int8"}), preserve_index=False)

        for b in batches:
            if not b.num_rows:
                continue
            for k, g in b.to_pandas().groupby(["repo", "fh", "blk"], sort=False):
                if key is not None and k != key:
                    yield done()
                    head = tail = None
                    count = 0
                key = k
                g = g.assign(gap=0)
                if tail is not None:
                    before = tail
                    g = g[~((g.pos == before.pos.iloc[-1]) & (g.hash == before.hash.iloc[-1]))]
                g = g.drop_duplicates(["pos", "hash"])
                if not len(g):
                    continue
                missing = window - (0 if head is None else len(head))
                if missing > 0:
                    head = g.head(missing) if head is None else pd.concat([head, g.head(missing)])
                tail = (g if tail is None else pd.concat([tail, g])).tail(window)
                count += len(g)
        if key is not None:
            yield done()

    return run


def _merge(df: DataFrame, *keys: str) -> DataFrame:
    """Intervals that overlap or follow each other directly, merged within ``keys``."""
    w = Window.partitionBy(*keys).orderBy("a", "b", "nx")
    before = F.max("nx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0)
    return (
        df.withColumn("new", new)
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "island")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("nx").alias("nx"))
        .drop("island")
    )


def shared_intervals(prints: DataFrame, window: int = 16) -> DataFrame:
    """Maximal shared intervals (repo, fh, a, b), fh being the file's 64-bit hash within its repository."""
    rows = prints.where("hash is not null and repo is not null and file is not null and pos is not null").select(
        F.col("repo").cast("long").alias("repo"), F.xxhash64("file").alias("fh"), F.shiftright(F.col("pos"), BLOCK_BITS).cast("int").alias("blk"), F.col("pos").cast("int").alias("pos"), F.col("hash").cast("long").alias("hash")
    )
    order = ["repo", "fh", "blk", "pos", "hash"]
    inner = rows.repartition("repo", "fh", "blk").sortWithinPartitions(*order).mapInArrow(_windows(window, True), WINDOW_SCHEMA)
    windows = inner
    # Pushed down to the scan; most collections have few files beyond one block, or none.
    long_files = materialise(prints.where(F.col("pos") >= 1 << BLOCK_BITS).where("hash is not null and repo is not null and file is not null").select(F.col("repo").cast("long").alias("repo"), F.xxhash64("file").alias("fh")).distinct(), "long_files")
    n_long = long_files.count()
    borders = (
        rows.join(F.broadcast(long_files) if n_long <= BROADCAST_FILES else long_files, ["repo", "fh"], "left_semi")
        .repartition("repo", "fh", "blk")
        .sortWithinPartitions(*order)
        .mapInArrow(_border_rows(window), "repo long, fh long, blk int, pos int, hash long, gap byte")
        .repartition("repo", "fh")
        .sortWithinPartitions(*order)
        .mapInArrow(_windows(window, False), WINDOW_SCHEMA)
    )
    if n_long:
        windows = windows.unionByName(borders)
    g = Window.partitionBy("w", "v")
    shared = (
        windows
        .withColumn("many", (F.min("repo").over(g) < F.max("repo").over(g)) | (F.min("fh").over(g) < F.max("fh").over(g)))
        .where("direct or many")
        .select("repo", "fh", "a", "b", "nx")
    )
    in_block = _merge(shared.withColumn("blk", F.shiftright("a", BLOCK_BITS)), "repo", "fh", "blk")
    return _merge(in_block.drop("blk"), "repo", "fh").select("repo", "fh", "a", "b")


def shared_spans(prints: DataFrame, window: int = 16) -> DataFrame:
    """(repo, file, pos_from, pos_to): each longest stretch of prints covered by shared windows."""
    names = prints.where("hash is not null and repo is not null and file is not null and pos is not null").select(F.col("repo").cast("long").alias("repo"), "file").distinct().withColumn("fh", F.xxhash64("file"))
    return shared_intervals(prints, window).join(names, ["repo", "fh"]).select("repo", "file", F.col("a").alias("pos_from"), F.col("b").alias("pos_to"))


def shared_report(prints: DataFrame, repos: DataFrame, window: int = 16) -> DataFrame:
    """Per record: number of spans, shared tokens, and their share of the file and of the repository's tokens.

    A span counts its token positions from first to last print; a file's length is its last print's position plus one;
    a repository's length is ``tokens``, or the sum of its files where that is null or smaller.
    """
    files = prints.where("hash is not null and repo is not null and file is not null and pos is not null").groupBy(F.col("repo").cast("long").alias("repo"), "file").agg((F.max("pos") + 1).cast("long").alias("file_tokens")).withColumn("fh", F.xxhash64("file"))
    spans = shared_intervals(prints, window).groupBy("repo", "fh").agg(F.count("*").alias("spans"), F.sum((F.col("b") - F.col("a") + 1).cast("long")).alias("shared_tokens"))
    whole = files.groupBy("repo").agg(F.sum("file_tokens").alias("held")).join(repos.select(F.col("id").alias("repo"), "tokens"), "repo", "left").select("repo", F.greatest("held", F.coalesce(F.col("tokens").cast("long"), F.lit(0))).alias("repo_tokens"))
    return (
        files.join(spans, ["repo", "fh"], "left")
        .join(whole, "repo")
        .select("repo", "file", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("shared_tokens", F.lit(0)).alias("shared_tokens"), "file_tokens", "repo_tokens")
        .withColumn("file_share", F.col("shared_tokens") / F.col("file_tokens"))
        .withColumn("repo_share", F.col("shared_tokens") / F.col("repo_tokens"))
    )
