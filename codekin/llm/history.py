"""New batches against all that was accepted before: by name, by address, and by content through fixed pivots.

Content: a repository is its set of hashes; the metric is the size of the symmetric difference, d(A, B) = |A| + |B| -
2 |A n B|. Two sets match when they share half of the smaller one, that is when d(A, B) <= max(|A|, |B|).

Pivots: the members of a batch are dealt to pivots of about ``PER_PIVOT`` members; a pivot P is the union of its members'
sets and the set C of common hashes, and stays as it is ever after. The table of members holds the distance d(A, P) = |P|
- |A| and is range-partitioned by pivot and distance. A probe lies at d(B, P) = |B| + |P| - 2 (|B n C| + r), r being the
number of its rarer hashes in P. By the triangle inequality d(A, B) >= d(B, P) - d(A, P), so a member can match only if
its stored distance lies in a range: all of the pivot where |B| <= 2 (|B n C| + r), else from |P| - 2 (|B n C| + r) on.
A second bound comes from the distance to C: |A n B| <= min(|A n C|, |B n C|) + r. Survivors are verified by exact
overlap. Members that share no rarer hash with the probe (r = 0) can match only if the smaller set consists by half of
common hashes; those sets probe with the few rarest common hashes that such a match needs.

A batch appends its own rows to every table; nothing older is rewritten or shuffled. The hashes of pivots are bucketed by
hash, so only the batch's hashes are sent to them. Whole sets are stored in directories per batch and group of pivots, and
only directories that hold a candidate are read to verify it; what a batch reads of whole sets doesn't grow with
batches that have nothing in common with it.

Skew: the hashes of a probe are counted per (probe, pivot) before the shuffle; a pivot holds about PER_PIVOT members
however large the batch is; equal names or addresses are reduced to the lowest id per batch before they are joined.

Defined results: null names, addresses and repositories match nothing; rows of one repository under several ids match
by name or address only; a repository that comes again is compared with what it held first; "earlier" is lower batch, then
lower id; rows with null id or batch are left aside; empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.llm.setjoin import distinct_sets
from codekin.scratch import discard, fresh_path, materialise

PER_PIVOT = 64
PER_GROUP = 64  # pivots
BUCKETS = 32
COMMON_SHARE = 0.002
COMMON_LEAST = 32


def name_key(col):
    """owner/name in lower case without blanks around, a trailing slash or ``.git``; null if empty."""
    k = F.lower(F.regexp_replace(F.regexp_replace(F.trim(col), r"/+$", ""), r"(?i)\.git$", ""))
    return F.when(k != "", k)


def address_key(col):
    """host/owner/name of an address, whatever its scheme, user, port and ending; null if empty."""
    k = F.regexp_replace(F.lower(F.trim(col)), r"^[a-z+]+://", "")
    k = F.regexp_replace(k, r"^[^/@]+@", "")
    k = F.regexp_replace(k, r"^([^/:]+):(?!\d+(/|$))/*", "$1/")
    k = F.regexp_replace(k, r"^([^/:]+):\d+", "$1")
    k = F.regexp_replace(k, r"^www\.", "")
    k = F.regexp_replace(F.regexp_replace(k, r"[/?#]+$", ""), r"\.git$", "")
    return F.when(k != "", k)


def first_by_key(rows: DataFrame, key) -> DataFrame:
    """(cand_id, first_id): lowest id among the earlier rows of the same key, for rows of batch 1 and later."""
    keyed = rows.select("cand_id", "batch_no", key.alias("key")).where("key is not null")
    low = keyed.groupBy("key", "batch_no").agg(F.min("cand_id").alias("own"))
    w = Window.partitionBy("key").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    low = low.withColumn("before", F.min("own").over(w)).where("batch_no >= 1")
    found = keyed.where("batch_no >= 1").join(low, ["key", "batch_no"]).select("cand_id", F.least("before", F.when(F.col("own") < F.col("cand_id"), F.col("own"))).alias("first_id"))
    return found.where("first_id is not null")


SCHEMAS = {
    "common": "tok long, df long",
    "tokens": "id long, tok long, common boolean, pivot long, batch int, part long",
    "members": "pivot long, size long, distance long, id long, c long, batch int",
    "heads": "tok long, id long, n long, batch int",
}


class HistoryIndex:
    """The accepted sets, their pivots and distances in a folder; a batch reads what it meets and appends its own rows.

    Tables: common (tok, df), fixed at the first batch; tokens (id, tok, common, pivot; directories by batch and group of
    pivots); hashes (pivot, tok, cnt), bucketed by tok; members (pivot, size, distance, id, c), size being the pivot's;
    heads (tok, id, n): the rarest common hashes of sets that consist by half of common ones.
    """

    def __init__(self, spark, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.batches: list[int] = []
        self.has_heads = False
        self.n_common = 0
        self.read_parts: list[str] = []  # directories of whole sets that the last match has read
        self.hashes = f"pivot_hashes_{uuid.uuid4().hex}"

    def _read(self, name: str, batches: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        return df if batches is None else df.where(F.col("batch").isin(batches))

    def _append(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", *by).parquet(f"{self.folder}/{name}")

    def accept(self, sets: DataFrame, batch: int, n: int | None = None) -> None:
        """Append the sets (id, tok; distinct) of records that weren't accepted yet; n is their number, if it is known."""
        if n is None or not self.batches:
            sets = materialise(sets.select("id", "tok"), "batch")
            n = sets.select("id").distinct().count() if n is None else n
        if not self.batches:
            limit = max(COMMON_LEAST, int(COMMON_SHARE * n))
            sets.groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") > limit).write.parquet(f"{self.folder}/common")
            self.n_common = self._read("common").count()
        common = self._read("common")
        number = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // PER_PIVOT))))
        tokens = sets.join(common.select("tok", F.lit(True).alias("common")), "tok", "left").select("id", "tok", F.coalesce("common", F.lit(False)).alias("common"), (number + F.lit(batch << 32)).alias("pivot"), F.floor(number / PER_GROUP).alias("part"))
        self._append(tokens, "tokens", batch, "part")
        discard(sets)
        tokens = self._read("tokens", [batch])
        # One shuffle by hash, in the buckets of the table.
        rare = tokens.where("not common").repartition(self.buckets, "tok").groupBy("pivot", "tok").agg(F.count("*").alias("cnt"))
        rare.write.mode("append" if self.batches else "overwrite").bucketBy(self.buckets, "tok").option("path", f"{self.folder}/hashes").saveAsTable(self.hashes)
        size = self.spark.table(self.hashes).where(F.shiftright("pivot", 32) == batch).groupBy("pivot").agg(F.count("*").alias("size"))
        own = tokens.groupBy("id", "pivot").agg(F.count("*").alias("n"), F.count_if("common").alias("c"))
        placed = own.join(size, "pivot", "left").withColumn("size", F.coalesce("size", F.lit(0)) + self.n_common)
        self._append(placed.select("pivot", "size", (F.col("size") - F.col("n")).alias("distance"), "id", "c").repartitionByRange("pivot", "distance").sortWithinPartitions("pivot", "distance"), "members", batch)
        # S needs n/2 of its c common hashes to match by them alone, so one of its c - n/2 + 1 rarest is shared.
        heavy = self._sizes([batch]).where("2 * c >= n").select("id", "n", (F.col("c") - F.ceil(F.col("n") / 2) + 1).alias("take"))
        if not heavy.isEmpty():
            place = F.row_number().over(Window.partitionBy("id").orderBy("df", "tok"))
            heads = tokens.where("common").join(heavy, "id").join(common, "tok").withColumn("place", place).where("place <= take").select("tok", "id", "n")
            self._append(heads, "heads", batch)
            self.has_heads = True
        self.batches.append(batch)

    def _sizes(self, batches: list[int]) -> DataFrame:
        """(id, pivot, n, c) of accepted records; a set's size is its pivot's less its distance to it."""
        return self._read("members", batches).select("id", "pivot", (F.col("size") - F.col("distance")).alias("n"), "c")

    def candidates(self, probes: DataFrame, tokens: DataFrame) -> DataFrame:
        """(probe, id, pivot) that the pivots can't rule out. probes: (id, n, c); tokens: (id, tok, common, pivot) of them."""
        rare = tokens.where("not common").select(F.col("id").alias("probe"), "tok", F.col("pivot").alias("own"))
        met = rare.join(self.spark.table(self.hashes), "tok").where((F.col("own") != F.col("pivot")) | (F.col("cnt") > 1))
        near = met.groupBy("probe", "pivot").agg(F.count("*").alias("r")).join(probes.select(F.col("id").alias("probe"), F.col("n").alias("pn"), F.col("c").alias("pc")), "probe")
        reach = 2 * (F.col("pc") + F.col("r"))
        # The range of stored distances that the triangle inequality leaves to the pivot's members.
        low = F.when(F.col("pn") <= reach, 0).otherwise(F.col("size") - reach)
        found = near.join(self._read("members").select("pivot", "size", "distance", "id", "c"), "pivot").where((F.col("distance") >= low) & (F.col("probe") != F.col("id")))
        smaller = F.least("pn", F.col("size") - F.col("distance"))
        out = found.where(F.ceil(smaller / 2) <= F.least("c", "pc") + F.col("r")).select("probe", "id", "pivot")
        if self.has_heads:
            everyone = self._sizes(self.batches)
            common_of = lambda t, s: t.where("common").select("id", "tok", "pivot").join(s.select("id", "n"), "id")
            heads = self._read("heads").select("tok", F.col("id").alias("small"), F.col("n").alias("small_n"))
            asked = heads.join(probes.select(F.col("id").alias("small")), "small", "left_semi").join(common_of(self._read("tokens"), everyone), "tok").where("small_n <= n").select(F.col("small").alias("probe"), "id", "pivot")
            old = heads.join(common_of(tokens, probes).select(F.col("id").alias("probe"), "tok", "n"), "tok").where("small_n <= n").select("probe", F.col("small").alias("id"))
            out = out.unionByName(asked).unionByName(old.join(everyone.select("id", "pivot"), "id").select("probe", "id", "pivot"))
        return out.where("probe != id").distinct()

    def match(self, ids: DataFrame, batch: int) -> DataFrame:
        """(probe, id): matches of accepted records (id) of ``batch`` among all accepted ones, those of the batch included."""
        self.read_parts = []
        asked = materialise(ids.select("id").distinct().join(self._sizes(self.batches), "id"), "asked")
        mine = lambda df: df.join(asked.select("id"), "id", "left_semi")
        probe_tokens = mine(self._sets(asked.select("pivot")))
        pairs = materialise(self.candidates(asked, probe_tokens), "pairs")
        member_tokens = self._sets(pairs.select("pivot"))
        a = probe_tokens.join(pairs.select(F.col("probe").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("probe"), "tok")
        b = member_tokens.join(pairs.select("id").distinct(), "id", "left_semi").select("id", "tok")
        overlap = pairs.select("probe", "id").join(a, "probe").join(b, ["id", "tok"]).groupBy("probe", "id").agg(F.count("*").alias("k"))
        sized = overlap.join(asked.select(F.col("id").alias("probe"), F.col("n").alias("pn")), "probe").join(self._sizes(self.batches).select("id", "n"), "id")
        out = materialise(sized.where(F.col("pn") + F.col("n") - 2 * F.col("k") <= F.greatest("pn", "n")).select("probe", "id"), "matches")
        discard(asked)
        discard(pairs)
        return out

    def _sets(self, pivots: DataFrame) -> DataFrame:
        """Whole sets in the directories of ``pivots`` (pivot): at most one directory per PER_PIVOT * PER_GROUP accepted records."""
        b, part = F.shiftright("pivot", 32).cast("int"), F.floor((F.col("pivot") - F.shiftleft(F.shiftright("pivot", 32), 32)) / PER_GROUP)
        parts = [f"batch={r.b}/part={r.part}" for r in pivots.select(b.alias("b"), part.alias("part")).distinct().collect()]
        self.read_parts = sorted({*self.read_parts, *parts})
        if not parts:
            return self.spark.createDataFrame([], "id long, tok long, common boolean, pivot long")
        return self.spark.read.schema("id long, tok long, common boolean, pivot long").parquet(*[f"{self.folder}/tokens/{p}" for p in sorted(parts)])

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.hashes}")


def match_batches(rows: DataFrame, sets_of, folder: str) -> DataFrame:
    """(probe, id): matching pairs of repositories where the probe has a row in batch 1 or later, found batch by batch.

    rows: (batch_no, repo); sets_of: gives the sets (id, tok; distinct) of the repositories in a table (id).
    """
    spark = rows.sparkSession
    listed = materialise(rows.where("repo is not null and batch_no is not null").select(F.col("repo").cast("long").alias("id"), F.col("batch_no").alias("batch")).distinct(), "listed")
    first = materialise(listed.groupBy("id").agg(F.min("batch").alias("batch")), "first")
    sizes = {r.batch: r.n for r in listed.select("batch", F.lit(0).alias("n")).unionByName(first.select("batch", F.lit(1).alias("n"))).groupBy("batch").agg(F.sum("n").alias("n")).collect()}  # a row per batch
    index = HistoryIndex(spark, folder)
    found = []
    for batch in sorted(sizes):
        if sizes[batch] or not index.batches:
            index.accept(sets_of(first.where(F.col("batch") == batch).select("id")), batch, sizes[batch])
        if batch >= 1:
            found.append(index.match(listed.where(F.col("batch") == batch).select("id"), batch))
    index.close()
    out = spark.createDataFrame([], "probe long, id long")
    for f in found:
        out = out.unionByName(f)
    return out.distinct()


def first_matches(rows: DataFrame, prints: DataFrame, boiler: DataFrame) -> DataFrame:
    """(first_id, cand_id) of every later row that matches an earlier one."""
    rows = rows.where("cand_id is not null and batch_no is not null")
    of_batch = lambda ids: distinct_sets(prints.join(ids.withColumnRenamed("id", "repo"), "repo", "left_semi"), "repo", "hash", boiler.select("hash"))
    pairs = materialise(match_batches(rows, of_batch, fresh_path(prints.sparkSession, "history")), "pairs")
    held = rows.where("repo is not null").select("cand_id", "batch_no", F.col("repo").alias("id"))
    probes = rows.where("repo is not null and batch_no >= 1").select(F.col("cand_id").alias("cand"), F.col("batch_no").alias("batch"), F.col("repo").alias("probe"))
    earlier = (F.col("batch_no") < F.col("batch")) | ((F.col("batch_no") == F.col("batch")) & (F.col("cand_id") < F.col("cand")))
    content = probes.join(pairs, "probe").join(held, "id").where(earlier).groupBy(F.col("cand").alias("c")).agg(F.min("cand_id").alias("first_id")).select(F.col("c").alias("cand_id"), "first_id")
    found = first_by_key(rows, name_key(F.col("full_name"))).unionByName(first_by_key(rows, address_key(F.col("clone_url")))).unionByName(content)
    return found.groupBy("cand_id").agg(F.min("first_id").alias("first_id")).select("first_id", "cand_id")
