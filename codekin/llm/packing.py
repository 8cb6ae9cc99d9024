"""Filling containers of fixed capacity with texts measured in tokens.

Sum-of-squares packing (Csirik et al., "On the Sum-of-Squares Algorithm for Bin Packing", JACM 2006): an item goes
where the sum over gaps g of the squared number of open containers with gap g becomes smallest. A text longer than the
capacity fills whole containers of its own first; only its last piece is packed with others.

Plan: token counts are made in one pass over the texts and kept as a small table; texts travel no further. Items are
spread by a hash of id and size over groups of about ``group_tokens`` tokens, each packed on its own, so the number of
groups follows the data and a group fits into a task. A group leaves a few containers open, which is its whole loss
against packing everything at once. Each group is packed in its own order and by falling size; the better one counts.

Defined results: null and empty texts hold no tokens and are in no container; ids may repeat (each row is an item, told
apart by ``copy``); containers never hold more than the capacity; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.scratch import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
GROUP_TOKENS = 8_000_000

# Fixed value: the vocabulary's published pattern for splitting a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}


def encoder(name: str):
    """The tokenizer of a rank file that was sent to the executors, made once per worker process."""
    if name not in _encoders:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def token_counts(texts: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n): number of tokens of each text; special strings are ordinary text. ``tokenizer`` is a rank file the driver can read; executors get it from there."""
    texts.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches):
        enc = encoder(name)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["id", "n"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n int")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the given order; sizes are 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; full ones don't count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    bins = 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum, halved and less one: what the smaller gap gains against what the larger one loses.
        change = np.where(count[s:] > 0, count[: capacity - s + 1] - count[s:], far)
        change[0] = -count[s] - 1 if count[s] else far
        g = int(change.argmin())
        fresh = int(count[capacity - s]) if s < capacity else -1
        if change[g] != far and change[g] <= fresh:
            gap = g + s
            bin_no = open_bins[gap].pop()
            count[gap] -= 1
        else:
            g, bin_no = capacity - s, bins
            bins += 1
        if g:
            open_bins[g].append(bin_no)
            count[g] += 1
        where[i] = bin_no
    return where


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The better of packing in the given order and by falling size."""
    first = sum_of_squares(sizes, capacity)
    order = np.argsort(-sizes, kind="stable")
    second = np.empty_like(first)
    second[order] = sum_of_squares(sizes[order], capacity)
    return first if first.max(initial=-1) <= second.max(initial=-1) else second


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(container, id, copy, piece, start, n) of the rows of ``sizes`` (id, n)."""
    # Rows that are equal in id and size are told apart by a number.
    items = sizes.where("id is not null and n > 0").groupBy("id", "n").agg(F.count("*").alias("k")).select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("copy"))
    items = materialise(items, "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    items = items.withColumn("grp", F.pmod(F.xxhash64("id", "n", "copy"), F.lit(groups)))
    rest = items.select("grp", "id", "copy", (F.col("n") % capacity).cast("int").alias("n"), F.floor(F.col("n") / capacity).cast("int").alias("piece")).where("n > 0")

    def run(pdf):
        pdf = pdf.sort_values(["id", "copy"], ignore_index=True)
        return pdf.assign(slot=pack_group(pdf.n.to_numpy(np.int64), capacity))[["grp", "slot", "id", "copy", "piece", "n"]]

    packed = rest.groupBy("grp").applyInPandas(run, "grp long, slot long, id long, copy long, piece int, n int")
    packed = packed.select(F.format_string("%d-%d", "grp", "slot").alias("container"), "id", "copy", "piece", (F.col("piece") * capacity).alias("start"), "n")
    whole = items.where(F.col("n") >= capacity).select("id", "copy", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / capacity).cast("int") - 1)).alias("piece"))
    whole = whole.select(F.format_string("w-%d-%d-%d", "id", "copy", "piece").alias("container"), "id", "copy", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).alias("n"))
    return packed.unionByName(whole)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, room left and its share."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).withColumn("room", F.col("containers") * capacity - F.col("tokens")).withColumn("room_share", F.col("room") / F.nullif(F.col("containers") * capacity, F.lit(0)))


def packed_pages(pages: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Containers of the pages' texts."""
    return pack(materialise(token_counts(pages, "doc_id", "text", tokenizer), "tokens"), capacity)


def container_order(packed: DataFrame) -> DataFrame:
    """Pieces with their token offset inside the container."""
    w = Window.partitionBy("container").orderBy("id", "copy", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
