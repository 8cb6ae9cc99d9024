"""Frequency of every distinct term: occurrences and records, kept up by signed deltas.

A state holds rows (part, term, n_rows, n_records); parts are hash ranges of the term. A change of a record is its old
version with sign -1 and its new one with +1; only such records are read. ``n_records`` moves by +1 or -1 per (term,
record). An update aggregates the changed records per term and appends the signed changes to the parts they meet; no
stored row is read or rewritten for it. The count of a term is the sum over its rows. A part is merged into one row a term
only when its appended rows have grown to ``MERGE_AT`` of its merged ones, so each row is rewritten a bounded number of
times on average, however often small deltas come.

All aggregations combine before the shuffle, so a term with a third of all rows sends one row per task and record.

Defined results: null terms and null records are left aside; exact repeats of a row count once; terms that fall to zero
don't show in the counts; an empty delta leaves the state as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.scratch import discard, materialise

PARTS = 32
MERGE_AT = 0.5
SCHEMA = "term long, n_rows long, n_records long, merged boolean, part int"


def record_terms(rows: DataFrame, term: str, record: str, unit: str | None = None, places: list[str] | None = None) -> DataFrame:
    """(term, record, k): distinct rows per term and record, told apart by ``unit`` (a part of a record, such as its file) and ``places`` in it; without them k is 1.

    Rows are spread by unit and counted in the same stage, so they cross the network once and their counts a second time.
    """
    cols = [F.col(term).alias("term"), F.col(record).alias("record")]
    base = rows.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    if unit is None:
        return base.select(*cols).distinct().withColumn("k", F.lit(1))
    told = [F.col(c).alias(f"_{i}") for i, c in enumerate([unit, *(places or [])])]
    once = base.select(*cols, *told).repartition("record", "_0").distinct()
    return once.groupBy("term", "record").agg(F.count("*").alias("k"))


def delta(terms: DataFrame, sign: int) -> DataFrame:
    """Signed change per term for records that come (+1) or go (-1)."""
    return terms.groupBy("term").agg(F.sum(F.col("k") * sign).alias("n_rows"), F.sum(F.lit(sign)).alias("n_records"))


def changes(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Signed change per term from the old to the new versions of the touched records."""
    parts = [delta(t, s) for t, s in ((old, -1), (new, 1)) if t is not None]
    if len(parts) == 1:
        return parts[0]
    return parts[0].unionByName(parts[1]).groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records")).where("n_rows != 0 or n_records != 0")


def _part(parts: int):
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")


class TermTable:
    """Persistent counts in a folder, one directory per part: merged rows, and signed changes appended since."""

    def __init__(self, spark, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder, parts

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def _write(self, rows: DataFrame, merged: bool, how: str) -> None:
        rows = rows.withColumn("merged", F.lit(merged)).withColumn("part", _part(self.parts))
        rows.repartition("part").write.partitionBy("part").mode(how).parquet(self.folder)

    def build(self, terms: DataFrame) -> None:
        self._write(delta(terms, 1), True, "overwrite")

    def update(self, old: DataFrame | None, new: DataFrame | None) -> None:
        """Signed changes from the old to the new versions of the touched records are appended; parts with many of them are merged."""
        self._write(changes(old, new), False, "append")
        self.merge(MERGE_AT)

    def merge(self, least: float) -> list[int]:
        """Merge the parts whose appended rows number at least ``least`` of their merged ones; which they were."""
        sizes = self.read().groupBy("part").agg(F.count_if("merged").alias("m"), F.count_if(~F.col("merged")).alias("a")).where("a > 0")
        due = sorted(r.part for r in sizes.where(F.col("a") >= F.lit(least) * F.col("m")).select("part").collect())  # at most ``parts``
        if due:
            summed = materialise(self._summed(self.read().where(F.col("part").isin(due))), "merged")
            # A part that has lost all terms keeps one empty row, so that its directory is replaced as well.
            kept = self.spark.createDataFrame([(p,) for p in due], "part int").select(F.lit(None).cast("long").alias("term"), F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_records"), F.lit(True).alias("merged"), "part")
            full = summed.withColumn("merged", F.lit(True)).withColumn("part", _part(self.parts)).unionByName(kept)
            full.repartition("part").write.option("partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite").parquet(self.folder)
            discard(summed)
        return due

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.where("term is not null").groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records")).where("n_rows > 0")

    def counts(self) -> DataFrame:
        """(term, n_rows, n_records)."""
        return self._summed(self.read())


def by_batches(terms: DataFrame, batches: DataFrame, table: TermTable) -> TermTable:
    """Counts of ``terms`` in ``table``: built from the records of the first batch, every later batch a delta. batches: (record, batch); records without one belong to the first."""
    first = batches.where("record is not null and batch is not null").groupBy("record").agg(F.min("batch").alias("batch"))
    numbers = sorted(r.batch for r in first.select("batch").distinct().collect())  # a row per batch
    start = numbers[0] if numbers else 0
    tagged = materialise(terms.join(first, "record", "left").withColumn("batch", F.coalesce("batch", F.lit(start))), "terms", by=["batch"])
    table.build(tagged.where(F.col("batch") == start))
    for n in numbers[1:]:
        table.update(None, tagged.where(F.col("batch") == n))
    discard(tagged)
    return table


def mark_terms(state: DataFrame, listed: DataFrame, n_records: DataFrame, common: float = 0.25, rare_below: int = 2) -> DataFrame:
    """(term, mark): 'common' from a share of all records on, 'rare' for listed terms in fewer than ``rare_below`` records."""
    often = state.crossJoin(F.broadcast(n_records)).where(F.col("n_records") >= F.col("total") * F.lit(common)).select("term", F.lit("common").alias("mark"))
    listed = listed.toDF("term").where("term is not null").distinct()
    seldom = listed.join(state, "term", "left").where(F.coalesce("n_records", F.lit(0)) < rare_below).select("term", F.lit("rare").alias("mark"))
    return often.unionByName(seldom)
