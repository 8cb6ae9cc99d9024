"""Maximal identical token runs between given pairs of repositories.

Only the two ends of a run are found: a start is a pair of equal grams whose preceding grams differ, an end one whose
following grams differ; on a diagonal each start belongs to the next end. Grams are first joined by (gram, neighbour)
kinds, so positions inside long equal stretches (tables of literals) never meet each other.

Defined results: runs are at least ``least`` tokens; streams shorter than the gram have none; a pair without such a run
has longest run 0.

``longest_common`` gives the longest run of very many pairs: the token texts of a pair's sides meet in one worker, where
substrings are searched. Streams above LONG tokens take the way of grams.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.operators import prints
from codekin.scratch import discard, materialise

K = 12
LEAST = 20
LONG = 32_768  # tokens of a stream that is searched as text
VOCABULARY = 1_000_000  # tokens that become characters at once
MEETING_BYTES = 1 << 26  # texts of the partners in one worker


def _with_neighbours(grams: DataFrame) -> DataFrame:
    """Adds prev and next where ``grams`` lacks them: grams of neighbouring positions meet in a join, so no stream is gathered."""
    if "prev" in grams.columns:
        return grams
    beside = lambda shift, name: grams.select("repo", (F.col("pos") + shift).alias("pos"), F.col("hash").alias(name))
    both = grams.join(beside(1, "prev"), ["repo", "pos"], "left").join(beside(-1, "next"), ["repo", "pos"], "left")
    return both.withColumns({"prev": F.coalesce("prev", F.lit(-1)), "next": F.coalesce("next", F.lit(-2))})


def _ends(pairs: DataFrame, grams: DataFrame, side: str, none: int) -> DataFrame:
    """(a, b, i, j) of equal grams whose neighbours on one side differ or are missing."""
    g = grams.select("repo", "hash", F.col(side).alias("n"), "pos")
    kinds = g.groupBy("repo", "hash", "n").agg(F.count("*").alias("k")).drop("k")
    ka = kinds.select(F.col("repo").alias("a"), "hash", F.col("n").alias("na"))
    kb = kinds.select(F.col("repo").alias("b"), "hash", F.col("n").alias("nb"))
    differing = pairs.select("a", "b").join(ka, "a").join(kb, ["b", "hash"]).where((F.col("na") != F.col("nb")) | (F.col("na") == none))
    pa = g.select(F.col("repo").alias("a"), "hash", F.col("n").alias("na"), F.col("pos").alias("i"))
    pb = g.select(F.col("repo").alias("b"), "hash", F.col("n").alias("nb"), F.col("pos").alias("j"))
    return differing.join(pa, ["a", "hash", "na"]).join(pb, ["b", "hash", "nb"]).select("a", "b", "i", "j")


def maximal_runs(pairs: DataFrame, grams: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """(a, b, i, j, tokens): runs of ``least`` tokens or more; grams: (repo, pos, hash) of every k-gram, dense in pos, with prev and next if at hand."""
    # Grams, starts and ends are written one after the other: in one plan each would stand many times, and the driver holds all of it.
    g = materialise(_with_neighbours(grams.join(pairs.select(F.col("a").alias("repo")).unionByName(pairs.select(F.col("b").alias("repo"))).distinct(), "repo", "left_semi")), "grams")
    starts = materialise(_ends(pairs, g, "prev", -1), "starts").withColumn("end", F.lit(0))
    ends = materialise(_ends(pairs, g, "next", -2), "ends").withColumn("end", F.lit(1))
    discard(g)
    # The i-th start on a diagonal goes with the i-th end; positions on it rise together.
    w = Window.partitionBy("a", "b", F.col("i") - F.col("j")).orderBy("i", "end")
    marks = starts.unionByName(ends).withColumn("stop", F.lead("i").over(w))
    return marks.where("end = 0").select("a", "b", "i", "j", (F.col("stop") - F.col("i") + k).alias("tokens")).where(F.col("tokens") >= least)


def longest_runs(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(a, b, longest) for every pair, 0 without a run."""
    best = runs.groupBy("a", "b").agg(F.max("tokens").alias("longest"))
    return pairs.select("a", "b").distinct().join(best, ["a", "b"], "left").select("a", "b", F.coalesce("longest", F.lit(0)).alias("longest"))


def longest_substring(a: str, b: str, least: int) -> int:
    """Length of the longest common substring, 0 below ``least`` (2 or more)."""
    best = least - 1
    half = (best + 1) // 2
    p = half - 1
    # A substring of best + 1 characters that starts at p - half + 1 .. p holds a[p : p + half].
    while p + half <= len(a):
        if a[p : p + half] in b:
            for i in range(p - half + 1, p + 1):
                while i + best < len(a) and a[i : i + best + 1] in b:
                    best += 1
        half = (best + 1) // 2
        p += half
    return best if best >= least else 0


def _longest(pairs: pa.Table, streams: pa.Table, least: int) -> tuple[list, list, list]:
    """Columns (a, b, longest) of the given (a, text, b); streams: (repo, text) of every b."""
    words = dict(zip(streams.column("repo").to_pylist(), streams.column("text").to_pylist(), strict=True))
    own: dict = {}
    for a, text, b in zip(*(pairs.column(c).to_pylist() for c in ("a", "text", "b")), strict=True):
        own.setdefault(a, (text, []))[1].append(b)
    out: tuple[list, list, list] = [], [], []
    codes: dict[str, str] = {}
    coded: dict = {}
    for a, (text, partners) in own.items():
        tokens = text.split(" ")
        fresh = {t for t in tokens if t not in codes}
        if len(codes) + len(fresh) > VOCABULARY:
            codes, fresh = {}, set(tokens)
        if fresh:
            # Character 0 stands for tokens that no side a has had; texts with such are coded anew.
            codes.update((t, chr(i)) for i, t in enumerate(sorted(fresh), len(codes) + 1))
            coded.clear()
        mine = "".join([codes[t] for t in tokens])
        for b in partners:
            if b not in coded:
                coded[b] = "".join([codes.get(t, "\0") for t in words[b].split(" ")])
            for column, x in zip(out, (a, b, longest_substring(mine, coded[b], least)), strict=True):
                column.append(x)
    return out


def longest_common(pairs: DataFrame, sources: DataFrame, least: int = LEAST, long: int = LONG) -> DataFrame:
    """(a, b, longest) for every pair (a, b) of keys (strings) of ``sources`` (repo, relpath, text): the longest run of ``least`` tokens or more, else 0."""
    once = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "once")
    tokens = prints.computed(prints.file_tokens(sources), "toks").select("repo", "relpath", F.size("toks").alias("n"), F.array_join(F.transform("toks", lambda t: t["tok"]), " ").alias("text"))
    files = materialise(tokens, "files")
    stored, files = files, files.where("n > 0")
    lengths = materialise(files.groupBy("repo").agg(F.sum("n").alias("n"), F.sum(F.length("text")).alias("chars")), "lengths").where(F.col("n") >= least)
    fits = lengths.where(F.col("n") <= long).select("repo")
    in_order = F.array_sort(F.collect_list(F.struct("relpath", "text")))
    streams = materialise(files.join(fits.hint("merge"), "repo", "left_semi").groupBy("repo").agg(in_order.alias("files")).select("repo", F.array_join(F.transform("files", lambda f: f["text"]), " ").alias("text")), "streams")
    discard(stored)
    sized = once.join(lengths.toDF("a", "na", "ca"), "a").join(lengths.toDF("b", "nb", "cb"), "b")
    sized = materialise(sized.withColumn("fits", F.greatest("na", "nb") <= long).select("a", "b", "cb", "fits"), "sized")
    n_long, chars = sized.agg(F.count_if(~F.col("fits")), F.coalesce(F.sum(F.when(F.col("fits"), F.col("cb"))), F.lit(0))).first()
    meetings = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, -(-chars // MEETING_BYTES))
    met = sized.where("fits").select("a", "b")
    meeting = lambda: F.pmod(F.xxhash64("a"), F.lit(meetings)).alias("meeting")
    left = met.select("a", "b", meeting()).join(streams.toDF("a", "text").hint("merge"), "a").groupBy("meeting")
    right = met.select(meeting(), F.col("b").alias("repo")).distinct().join(streams.hint("merge"), "repo").groupBy("meeting")

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        a, b, longest = _longest(own, others, least)
        return pa.table([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(longest, pa.int32())], names=["a", "b", "longest"])

    found = left.cogroup(right).applyInArrow(run, "a string, b string, longest int")
    if n_long:
        rest = materialise(sized.where("not fits").select("a", "b"), "rest")
        grams = prints.kgrams(sources.join(rest.select(F.explode(F.array("a", "b")).alias("repo")).distinct(), "repo", "left_semi"), K, neighbours=True)
        found = found.unionByName(longest_runs(rest, maximal_runs(rest, grams, least)))
    found = materialise(found, "longest")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "longest"))
    return pairs.select("a", "b").distinct().join(both, ["a", "b"], "left").select("a", "b", F.coalesce("longest", F.lit(0)).alias("longest"))


def top_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n longest runs of each pair; among equals the later positions come first."""
    w = Window.partitionBy("a", "b").orderBy(F.desc("tokens"), F.desc("i"), F.desc("j"))
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def regions(runs: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """Runs with file and line of their first and last token on both sides; places: (repo, pos, file, line) of every token."""
    out = runs
    for side, at in (("a", "i"), ("b", "j")):
        for name, shift in (("start", F.lit(0)), ("end", F.col("tokens") - 1)):
            p = places.select(F.col("repo").alias(side), F.col("pos").alias("at"), F.col("file").alias(f"{side}_{name}_file"), F.col("line").alias(f"{side}_{name}"))
            out = out.withColumn("at", F.col(at) + shift).join(p, [side, "at"]).drop("at")
    return out.select("a", "b", "tokens", F.col("a_start_file").alias("a_file"), "a_start", "a_end", F.col("b_start_file").alias("b_file"), "b_start", "b_end")
