"""Token streams, k-gram hashes and winnowed fingerprints.

A repository's stream is the concatenation of its files in path order, so grams run over file borders. Streams are cut
into blocks of ``block`` tokens with as many tokens of the next block as grams and windows reach over; each block is an
independent row, so one giant repository spreads over many tasks and no stream is gathered in one. Token positions come
from a running sum over the files' token counts, which are small. Hashes and windows are made block by block in Arrow
batches; as expressions over arrays they would be interpreted.

Defined results: null texts have no tokens; repeated (repo, relpath) rows count once, the greatest text standing; streams
shorter than k have no grams; fewer than w grams give exactly one print; equal hashes in a window: the leftmost counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codekin.functions.paths import language_of
from codekin.functions.tokens import has_tokens, source_tokens
from codekin.scratch import materialise

BLOCK = 4096


def computed(df: DataFrame, *cols: str) -> DataFrame:
    """Keeps the optimizer from repeating costly array columns inside the expressions that use them: a generator ends their inlining."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.explode(F.array(F.struct(*cols))).alias("_c")).select(*rest, *[F.col(f"_c.{c}").alias(c) for c in cols])


def _once(sources: DataFrame) -> DataFrame:
    return sources.where("repo is not null and relpath is not null and text is not null").groupBy("repo", "relpath").agg(F.max("text").alias("text"))


def with_tokens(sources: DataFrame) -> DataFrame:
    """(repo): repositories whose stream has a token."""
    return _once(sources).where(has_tokens(F.col("text"), language_of(F.col("relpath")))).select("repo").distinct()


def file_tokens(sources: DataFrame, channel: str = "abstract") -> DataFrame:
    """(repo, relpath, toks): tokens with line numbers of each file."""
    return _once(sources).select("repo", "relpath", source_tokens(F.col("text"), language_of(F.col("relpath")), channel).alias("toks"))


def offsets(tokens: DataFrame) -> DataFrame:
    """(repo, relpath, offset, total): where each file starts in its repository's stream, and the stream's length."""
    n = tokens.select("repo", "relpath", F.size("toks").cast("long").alias("n")).where("n > 0")
    by_path = Window.partitionBy("repo").orderBy("relpath")
    return n.select("repo", "relpath", (F.sum("n").over(by_path) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("repo")).alias("total"))


def blocks(tokens: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """(repo, total, start, toks): tokens start .. start + size of each block, with one token before and ``reach`` after it."""
    # Never by broadcast: a written table of tokens seems small by its compressed files, and the driver would hold it a hundred times larger.
    placed = tokens.join(offsets(tokens).hint("merge"), ["repo", "relpath"])
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("offset") - reach) / block))
    last = F.floor((F.col("offset") + F.size("toks")) / block)
    parts = placed.withColumn("b", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("b") * block - 1, F.col("offset"))
    hi = F.least((F.col("b") + 1) * block + reach, F.col("offset") + F.size("toks"))
    parts = parts.withColumns({"lo": lo, "hi": hi}).where("hi > lo")
    piece = F.transform(F.slice("toks", (F.col("lo") - F.col("offset") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), lambda t: F.struct(t["tok"].alias("tok"), t["line"].alias("line"), F.col("relpath").alias("file")))
    grouped = parts.select("repo", "total", "b", "lo", piece.alias("piece")).groupBy("repo", "total", "b").agg(F.array_sort(F.collect_list(F.struct("lo", "piece"))).alias("pieces"))
    grouped = computed(grouped, "pieces")
    return computed(grouped.select("repo", "total", (F.col("b") * block).alias("begin"), F.col("pieces")[0]["lo"].alias("start"), F.flatten(F.transform("pieces", lambda p: p["piece"])).alias("toks")), "toks")


def _gram_hashes(words: list[str], k: int) -> np.ndarray:
    """Hash of each window of k words: the first 60 bits of its md5, which other engines have as well."""
    md5 = hashlib.md5
    return np.fromiter((int(md5(" ".join(words[i : i + k]).encode(), usedforsecurity=False).hexdigest()[:15], 16) for i in range(len(words) - k + 1)), np.int64, max(0, len(words) - k + 1))


def _block_grams(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(row, first token's place in the batch, begin, start, total, hashes) of each block with a gram."""
    toks = batch.column("toks")
    offsets = toks.offsets.to_numpy()
    words = toks.values.field("tok").to_pylist()
    numbers = [batch.column(c).to_pylist() for c in ("begin", "start", "total")]
    for row, (begin, start, total) in enumerate(zip(*numbers, strict=True)):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        if hi - lo >= k:
            yield row, lo, begin, start, total, _gram_hashes(words[lo:hi], k)


def _gathered(batch: pa.RecordBatch, rows: list[int], sizes: list[int]) -> pa.Array:
    return batch.column("repo").take(pa.array(np.repeat(np.array(rows, np.int64), np.array(sizes, np.int64))))


def _gram_blocks(sources: DataFrame, channel: str, k: int, reach: int, block: int) -> DataFrame:
    # Written once, as lengths and blocks both need the tokens and finding them costs most.
    return blocks(materialise(file_tokens(sources, channel), "tokens"), reach, block).where(F.col("total") >= k)


def kgrams(sources: DataFrame, k: int, channel: str = "abstract", block: int = BLOCK, neighbours: bool = False) -> DataFrame:
    """(repo, pos, hash) of every k-gram of every stream; with ``neighbours`` also prev and next, the hashes before and after it, or -1 and -2."""
    names = ["repo", "pos", "hash", *(["prev", "next"] if neighbours else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, parts = [], [], []
            for row, _, begin, start, _, h in _block_grams(batch, k):
                pos = np.arange(start, start + len(h))
                own = (pos >= begin) & (pos < begin + block)
                cols = [pos, h, np.concatenate([[-1], h[:-1]]), np.concatenate([h[1:], [-2]])]
                parts.append([c[own] for c in cols[: len(names) - 1]])
                rows.append(row)
                sizes.append(int(own.sum()))
            if rows:
                yield pa.RecordBatch.from_arrays([_gathered(batch, rows, sizes), *[pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)]], names=names)

    b = _gram_blocks(sources, channel, k, k if neighbours else k - 1, block).select("repo", "total", "begin", "start", F.transform("toks", lambda t: F.struct(t["tok"].alias("tok"))).alias("toks"))
    return b.mapInArrow(run, T.StructType([T.StructField("repo", b.schema["repo"].dataType), *[T.StructField(n, T.LongType()) for n in names[1:]]]))


def winnow(sources: DataFrame, k: int, w: int, channel: str = "abstract", block: int = BLOCK) -> DataFrame:
    """(repo, hash, file, line, pos): leftmost least hash of every window of w grams, once per position."""
    names = ["repo", "hash", "file", "line", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, parts = [], [], []
            for row, lo, begin, start, total, h in _block_grams(batch, k):
                # Windows that start in this block, and the one before, whose print belongs to the block before.
                stop = min(begin + block, max(1, total - k + 1 - w + 1))
                if stop <= begin:
                    continue
                padded = np.concatenate([h, np.full(w, np.iinfo(np.int64).max)])
                least = np.lib.stride_tricks.sliding_window_view(padded, w)[: stop - start].argmin(axis=1) + np.arange(stop - start)
                at = np.unique(least)
                if start < begin:
                    at = at[at != least[0]]
                parts.append((h[at], at + lo, at + start))
                rows.append(row)
                sizes.append(len(at))
            if rows:
                h, place, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
                tokens = batch.column("toks").values
                place = pa.array(place)
                yield pa.RecordBatch.from_arrays([_gathered(batch, rows, sizes), pa.array(h, pa.int64()), tokens.field("file").take(place), tokens.field("line").take(place).cast(pa.int64()), pa.array(pos, pa.int64())], names=names)

    b = _gram_blocks(sources, channel, k, k + w - 2, block).select("repo", "total", "begin", "start", "toks")
    kinds = [b.schema["repo"].dataType, T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    out = b.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))
    return out.withColumn("line", F.col("line").cast(b.schema["toks"].dataType.elementType["line"].dataType))


def density(sources: DataFrame, k: int, w: int) -> DataFrame:
    """One row: tokens, grams, prints and prints per gram."""
    lengths = offsets(file_tokens(sources)).groupBy("repo").agg(F.max("total").alias("n"))
    grams = lengths.agg(F.sum("n").alias("tokens"), F.sum(F.greatest(F.col("n") - k + 1, F.lit(0))).alias("grams"))
    prints = winnow(sources, k, w).agg(F.count("*").alias("prints"))
    return grams.crossJoin(prints).withColumn("prints_per_gram", F.col("prints") / F.col("grams"))  # one row each
