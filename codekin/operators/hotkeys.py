"""Per-key results when a few keys hold most rows.

``heavy_keys`` finds every key with at least a given share of the rows by refining a histogram of the key's hash:
counts per 16-bit prefix first, then only inside prefixes that are heavy enough, and exact counts of the few keys left.
Counts are mergeable and combined per task, so a round shuffles at most 65,536 counts per surviving prefix (of which
there are at most 1/share), never the keys themselves.

``key_profile`` counts rows and distinct values per key from combined partial results. ``key_quantiles`` selects exact
quantiles per key by refining value histograms until each rank is resolved; a hot key's values are only ever counted.

Defined results: null keys are left aside, null values don't take part in quantiles, a key without values has none, an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.scratch import materialise

MOST_PREFIXES = 1_000_000  # rows that may be broadcast
HOT_VALUES, SALTS = 1_000_000, 64
HOT_SHARE = 1e-4


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """(key, n) of the keys holding at least ``share`` of all rows with a key."""
    rows = df.select(F.col(key).alias("key")).where("key is not null")
    if share * MOST_PREFIXES < 1:
        # So many keys may be heavy that prefixes tell little apart: combined counts of all keys.
        total = rows.agg(F.count("*").alias("total"))
        return rows.groupBy("key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * F.lit(share)).select("key", "n")  # total is one row
    rows = rows.withColumn("h", F.xxhash64("key"))
    short, longer = F.shiftrightunsigned("h", 48).alias("p"), F.shiftrightunsigned("h", 32).alias("p")
    first = rows.groupBy(short).agg(F.count("*").alias("n")).withColumn("least", F.sum("n").over(Window.partitionBy()) * F.lit(share))
    first = materialise(first.where("n >= least").select("p", "least"), "prefixes")  # of at most 65,536 rows
    second = rows.select(short, longer.alias("p2"), "key").join(F.broadcast(first), "p").groupBy("p2", "least").agg(F.count("*").alias("n")).where("n >= least")
    second = materialise(second.select(F.col("p2").alias("p"), "least"), "prefixes")  # at most 1/share rows
    return rows.select(longer, "key").join(F.broadcast(second), "p").groupBy("key", "least").agg(F.count("*").alias("n")).where("n >= least").select("key", "n")


def with_key_counts(rows: DataFrame, key: str, hot: DataFrame, name: str = "df") -> DataFrame:
    """``rows`` with the number of rows of their key. hot: (key) of ``heavy_keys``, few enough to be broadcast.

    The rows of a hot key stay where they are and meet a combined count; only other keys are gathered.
    """
    hot = hot.select(F.col("key").alias(key), F.lit(True).alias("_hot"))
    tagged = rows.join(F.broadcast(hot), key, "left")
    cold = tagged.where("_hot is null").drop("_hot").withColumn(name, F.count("*").over(Window.partitionBy(key)))
    of_hot = tagged.where("_hot").drop("_hot")
    return cold.unionByName(of_hot.join(F.broadcast(of_hot.groupBy(key).agg(F.count("*").alias(name))), key).select(*cold.columns))


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], size: str, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` and ``counted`` (a row per key, with its number of rows in ``size``) that gathers no hot key: keys with a share of all rows, at most 1/share, are broadcast."""
    total = counted.agg(F.sum(size)).first()[0] or 0
    hot = counted.where(F.col(size) >= max(total * share, 1.0))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counted.where(F.col(size) < max(total * share, 1.0)), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def key_profile(df: DataFrame, key: str, distinct: dict[str, list[str]]) -> DataFrame:
    """(key, n_rows, ...): rows per key and, for each name in ``distinct``, the number of distinct value tuples.

    A distinct count is a count over rows made unique by (key, values): the first aggregation spreads a hot key over
    all tasks, the second receives one partial count per task and key. Tuples with a null are not counted.
    """
    base = df.where(F.col(key).isNotNull())
    out = base.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows"))
    for name, cols in distinct.items():
        whole = base.na.drop(subset=cols)
        part = whole.select(F.col(key).alias("key"), *cols).distinct().groupBy("key").agg(F.count("*").alias(name))
        out = out.join(part, "key", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def key_quantiles(df: DataFrame, key: str, value: str, quantiles: list[float], bits: int = 8, hot: int = HOT_VALUES) -> DataFrame:
    """(key, q, v): exact quantiles of an integer ``value`` per key, v being the value at 0-based rank floor(q * n), n-1 at most.

    Rows become counts per (key, value) once; each round then counts per (key, bucket) inside the current interval of
    every rank and moves to the bucket that holds the rank. 64-bit values take 64/bits rounds at most, as many as the
    widest range needs. Keys with more than ``hot`` different values are spread over several tasks.
    """
    counts = materialise(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).cast("long").alias("x")).agg(F.count("*").alias("n")), "values")
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    ranges = materialise(counts.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("n"), F.count("*").alias("m")), "ranges")
    # Most keys have one value only; they are done, and their counts needn't be read again.
    plain = ranges.where("low = high").select("key", qs.alias("q"), F.col("low").alias("v"))
    ranges = ranges.where("low < high")
    span, n_hot = ranges.agg(F.max(F.col("high") - F.col("low")), F.count_if(F.col("m") > hot)).first()
    if span is None:
        return plain
    state = ranges.select("key", F.col("low"), F.col("n"), qs.alias("q"), F.when(F.col("m") > hot, F.lit(SALTS)).otherwise(F.lit(1)).alias("salts")).withColumn("rank", F.least(F.floor(F.col("q") * F.col("n")), F.col("n") - 1)).drop("n")
    state = materialise(state, "ranks")
    # Values of keys with very many of them are dealt to SALTS parts, each of which meets the key's ranks; the list of such
    # keys is broadcast, as there is at most one in ``hot`` values, unless even that is long: then none of them stands out.
    salt = F.lit(0)
    if 0 < n_hot <= MOST_PREFIXES:
        tagged = counts.join(F.broadcast(ranges.where(F.col("m") > hot).select("key", F.lit(True).alias("is_hot"))), "key", "left")
        counts, salt = tagged, F.when(F.col("is_hot"), F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    else:
        state = state.withColumn("salts", F.lit(1))
    counts = counts.select("key", "x", "n", salt.alias("salt"))
    shift = max(0, -(-max(int(span).bit_length(), 1) // bits) * bits)
    while shift > 0:
        shift -= bits
        ranks = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        inside = counts.join(ranks, ["key", "salt"]).where(F.col("x") >= F.col("low"))
        if shift + bits < 63:
            inside = inside.where(F.col("x") - F.col("low") < F.lit(1 << (shift + bits)))
        hist = inside.groupBy("key", "q", "low", "rank", "salts", F.shiftright(F.col("x") - F.col("low"), shift).alias("bucket")).agg(F.sum("n").alias("n"))
        w = Window.partitionBy("key", "q").orderBy("bucket")
        upto = hist.withColumn("upto", F.sum("n").over(w))  # at most 2**bits rows a key and rank
        state = materialise(
            upto.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select("key", "q", "salts", (F.col("low") + F.shiftleft("bucket", shift)).alias("low"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")),
            "ranks",
        )
    return plain.unionByName(state.select("key", "q", F.col("low").alias("v")))
