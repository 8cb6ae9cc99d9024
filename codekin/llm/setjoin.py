"""All similar pairs between set-valued records, by containment in the smaller set.

Records are compared on distinct tokens; a pair matches when the common tokens number at least ``share`` of the smaller
set. Tokens are ordered by rarity (document frequency); ties stay together, so a prefix is "all tokens up to a
frequency" and needs no per-record sort.

Prefix bound: for a set of n tokens with need t = ceil(share * n), the prefix holds at least n - t + l tokens with
l = ceil(t / 2). Any superset-sized partner that shares t tokens shares at least t - (n - prefix) of them with the
prefix. Only prefix tokens of the smaller set probe the index, pairs below that count are dropped, and the survivors
are verified exactly by counting the tokens beyond the prefix. Length filter: the probe only meets sets of equal or
larger size. Positional filter: at a token of frequency f two sets can share no more than the fewer of their rarer
tokens and the fewer of their tokens from f on; where that is below t, the row is dropped in the join.

The index holds whole sets, as a small set may need one token only, whatever the size of its partner. A token of very
many sets is never gathered: its rows keep their place and meet a combined count.

Skew: exact copies of a set join once, through a representative (the lowest id with the same 128-bit set fingerprint
and size), and are expanded by membership. Frequencies and prefixes come from counts per (record, frequency), so a
record or token holding a third of all rows is combined before each shuffle.

Defined results: null ids and null tokens are left aside, repeats count once, excluded tokens don't count for sizes,
records without tokens match nothing, an empty table gives no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.operators.hotkeys import HOT_SHARE, heavy_keys, join_counted, with_key_counts
from codekin.scratch import materialise


@dataclass
class SetJoin:
    """Classes of equal sets and the matching pairs of their representatives."""

    members: DataFrame  # id, rep, n
    pairs: DataFrame  # a, b, common, na, nb of representatives


def distinct_sets(df: DataFrame, id_col: str, token_col: str, exclude: DataFrame | None = None) -> DataFrame:
    """(id, tok): distinct tokens of each record without those of ``exclude``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(token_col).alias("tok")).where("id is not null and tok is not null").distinct()
    if exclude is not None:
        c = exclude.columns[0]
        rows = rows.join(exclude.select(F.col(c).alias("tok")).where("tok is not null").distinct(), "tok", "left_anti")
    return rows.select("id", "tok")


def similar_sets(sets: DataFrame, share: float = 0.5, hot: DataFrame | None = None) -> SetJoin:
    """Pairs among the rows of ``sets`` (id, tok; distinct). hot: (key) of tokens known to stand in very many sets; found here if not given."""
    with_df = with_key_counts(sets, "tok", heavy_keys(sets, "tok", HOT_SHARE) if hot is None else hot)
    base = materialise(
        # A token held by one record can't be common to two: only its number counts, so it is folded into one row.
        with_df.groupBy("id", F.when(F.col("df") > 1, F.col("tok")).alias("tok"), "df").agg(F.count("*").alias("k"), F.bit_xor("tok").alias("x"), F.bit_xor(F.xxhash64("tok")).alias("y")),
        "sets",
    )
    marks = materialise(base.groupBy("id").agg(F.sum("k").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")), "marks")
    classes = marks.groupBy("n", "x", "y").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    members = materialise(join_counted(marks, classes, ["n", "x", "y"], "size").select("id", "rep", "n"), "members")
    others = members.where("id != rep").select("id")
    reps = base.join(others, "id", "left_anti")

    # Place of each frequency in each record, and the record's prefix, from its counts per frequency.
    by_df = reps.groupBy("id", "df").agg(F.sum("k").alias("k"))
    up = Window.partitionBy("id").orderBy("df")
    total = Window.partitionBy("id")
    places = by_df.select("id", "df", "k", F.sum("k").over(up).alias("upto"), F.sum("k").over(total).alias("n")).withColumn("t", F.ceil(F.col("n") * F.lit(share)))
    want = F.least(F.col("n"), F.col("n") - F.col("t") + F.ceil(F.col("t") / 2))
    # The prefix ends with the first frequency that reaches the wanted length.
    last = F.min(F.when(F.col("upto") >= want, F.col("upto"))).over(total)
    places = places.withColumn("last", last).select("id", "df", "n", "t", (F.col("upto") - F.col("k")).alias("before"), (F.col("upto") <= F.col("last")).alias("prefix"), (F.col("t") - (F.col("n") - F.col("last"))).alias("need"))
    held = reps.where("tok is not null").select("id", "tok", "df")
    sized = materialise(held.join(places, ["id", "df"]), "sized")

    a = sized.where("prefix").select(F.col("id").alias("a"), "tok", F.col("n").alias("na"), "t", "need", F.col("before").alias("pa"))
    b = sized.select(F.col("id").alias("b"), "tok", F.col("n").alias("nb"), F.col("before").alias("pb"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    placed = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.col("t")
    candidates = (
        a.join(b, "tok")
        .where(ordered & placed)
        .groupBy("a", "b")
        .agg(F.count("*").alias("c"), F.max("need").alias("need"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        .where("c >= need")
    )
    candidates = materialise(candidates.select("a", "b", "c", "na", "nb"), "candidates")
    rest = sized.where("not prefix").select(F.col("id").alias("a"), "tok")
    beyond = (
        candidates.select("a", "b")
        .join(rest, "a")
        .join(sized.select(F.col("id").alias("b"), "tok"), ["b", "tok"], "left_semi")
        .groupBy("a", "b")
        .agg(F.count("*").alias("more"))
    )
    pairs = (
        candidates.join(beyond, ["a", "b"], "left")
        .select("a", "b", (F.col("c") + F.coalesce("more", F.lit(0))).alias("common"), "na", "nb")
        .where(F.col("common") >= F.ceil(F.least("na", "nb") * F.lit(share)))
    )
    return SetJoin(members, pairs)


def expand_pairs(join: SetJoin) -> DataFrame:
    """(a, b), a < b, of all records: representatives' pairs through membership, and the pairs inside each class."""
    m = join.members
    left = m.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    right = m.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = join.pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    copied = m.where("id != rep").select("rep").distinct()
    c = m.join(copied, "rep", "left_semi")
    inside = c.select("rep", F.col("id").alias("a")).join(c.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b")
    return across.unionByName(inside)


def link_counts(join: SetJoin) -> DataFrame:
    """(id, class_id, members, links): a record's class of equal sets and its number of partners, without expanding."""
    size = join.members.groupBy("rep").agg(F.count("*").alias("members"))
    both = join.pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(join.pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    across = both.join(size.select(F.col("rep").alias("other"), F.col("members").alias("k")), "other").groupBy("rep").agg(F.sum("k").alias("across"))
    return (
        join.members.join(size, "rep")
        .join(across, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), "members", (F.col("members") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    )


def repository_pairs(prints: DataFrame, boiler: DataFrame, share: float = 0.5) -> SetJoin:
    """The join over repositories as sets of print hashes without the listed boilerplate."""
    hot = heavy_keys(prints.where("repo is not null"), "hash", HOT_SHARE)
    return similar_sets(distinct_sets(prints, "repo", "hash", boiler.select("hash")), share, hot)
