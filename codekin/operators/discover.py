"""Candidate discovery over tables: event logs, search results, merging and resuming.

Defined results: null names are left aside; conditions are columns, never text put into SQL; comparisons of names in
the event log ignore case.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRANCHES = ("main", "master", "develop", "HEAD")  # fixed values, in order of preference


def contains_any(col: Column, parts: list[str]) -> Column:
    """Whether one of the parts stands in the text, letters' case aside."""
    return reduce(or_, [F.contains(F.lower(col), F.lit(p.lower())) for p in parts], F.lit(False))


def matches_any(col: Column, patterns: list[str]) -> Column:
    return reduce(or_, [col.rlike(p) for p in patterns], F.lit(False))


def from_events(events: DataFrame, parts: list[str], prefilter: str | None = None, min_events: int = 1) -> DataFrame:
    """Candidates from an event log (repo_name, created_at): events, first and last day per name; names without a slash are no repositories."""
    rows = events.where(contains_any(F.col("repo_name"), parts) & F.contains("repo_name", F.lit("/")))
    if prefilter:
        rows = rows.where(contains_any(F.col("repo_name"), [prefilter]))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    found = rows.groupBy(F.col("repo_name").alias("full_name")).agg(F.count("*").alias("archive_events"), day(F.min("created_at")).alias("first_seen"), day(F.max("created_at")).alias("pushed_at"))
    return found.where(F.col("archive_events") >= min_events).withColumns({"owner": F.split("full_name", "/")[0], "size": F.lit(0), "found_by": F.lit("events")})


def late_events(events: DataFrame, days: int = 1) -> DataFrame:
    """(late, events): how many events were logged later than ``days`` after they happened; unknown times are their own row."""
    late = F.col("logged_at") > F.col("created_at") + F.make_dt_interval(F.lit(days))
    return events.distinct().groupBy(late.alias("late")).agg(F.count("*").alias("events"))


def month_slices(spark, first: str, last: str) -> DataFrame:
    """(slice): first_day..last_day of each month from ``first`` to ``last`` (yyyy-MM)."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.concat(F.col("m").cast("string"), F.lit(".."), F.last_day("m").cast("string")).alias("slice"))


def keep(candidates: DataFrame, low: int | None = None, high: int | None = None, skip_forks: bool = True, archived: str | None = None) -> DataFrame:
    """Candidates that are no forks, inside the size band (both ends included, a missing size is 0), and not archived and empty."""
    size = F.coalesce("size", F.lit(0))
    ok = F.lit(True)
    if skip_forks:
        ok = ok & ~F.coalesce("fork", F.lit(False))
    if low is not None or high is not None:
        ok = ok & size.between(low or 0, high if high is not None else 10**9)
    if archived:
        ok = ok & ~(F.coalesce(archived, F.lit(False)) & (size == 0))
    return candidates.where(ok)


def first_source_wins(candidates: DataFrame, priority: Column, order: str) -> DataFrame:
    """One row per full_name: the source of the lowest priority value, then the lowest ``order``; combined before the shuffle."""
    cols = candidates.columns
    ranked = candidates.where("full_name is not null").groupBy("full_name").agg(F.min_by(F.struct(*cols), F.struct(priority.alias("p"), F.col(order).alias("o"))).alias("r"))
    return ranked.select("r.*")


def todo(candidates: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Candidates whose name isn't in the column ``name`` of the known ones."""
    return candidates.where("full_name is not null").join(known.select(F.col(name).alias("full_name")).where("full_name is not null").distinct(), "full_name", "left_anti")


def requeue(rows: DataFrame, reason: str, parts: list[str]) -> DataFrame:
    """Rows whose reason holds one of the parts, letters' case aside; a null reason holds none."""
    return rows.where(F.coalesce(contains_any(F.col(reason), parts), F.lit(False)))


def expand_by_owners(seeds: DataFrame, links: DataFrame, repos: DataFrame, patterns: list[str]) -> DataFrame:
    """Two hops: seeds (full_name), links (full_name, user), repos (full_name, owner, ...): repositories of the seeds' people by name, the seeds left out."""
    people = links.join(seeds.select("full_name").distinct(), "full_name", "left_semi").select("user").where("user is not null").distinct()
    short = F.element_at(F.split("full_name", "/"), -1)
    found = repos.where(matches_any(short, patterns)).join(people.withColumnRenamed("user", "owner"), "owner", "left_semi")
    return found.join(seeds.select("full_name").distinct(), "full_name", "left_anti")


def newest(df: DataFrame, keys: list[str], time: str, n: int = 3) -> DataFrame:
    """The n newest rows per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(time))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def from_search(items: DataFrame, low: int | None = None, high: int | None = None, skip_forks: bool = True) -> DataFrame:
    """Candidates from search results (full_name, size, fork, archived, ..., seq): the wanted ones, each name once, as first seen."""
    return first_source_wins(keep(items, low, high, skip_forks, "archived"), F.lit(0), "seq")


def merged(*sources: DataFrame) -> DataFrame:
    """Candidates of several sources, each name from the first source that has it."""
    rows = [s.withColumns({"_source": F.lit(i), "_at": F.monotonically_increasing_id()}) for i, s in enumerate(sources)]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return first_source_wins(every, F.col("_source"), "_at").drop("_source", "_at")


def resolve_snapshots(visits: DataFrame, branches: DataFrame, names: tuple[str, ...] = BRANCHES, newest_visits: int = 3) -> DataFrame:
    """(full_name, snapshot, branch, target): the revision to take of each archived repository.

    visits: (full_name, at, status, snapshot); branches: (snapshot, branch, kind, target), kind 'alias' naming another branch
    of the snapshot. Of the newest full visits with a snapshot the first with a usable branch counts; in it the branches of
    ``names`` in their order, then any other, the first by name. An alias is followed once; where it leads nowhere it isn't usable.
    """
    full = newest(visits.where("status = 'full' and snapshot is not null"), ["full_name"], "at", newest_visits).select("full_name", "snapshot", "rank")
    direct = branches.where("kind != 'alias' and target is not null").select("snapshot", "branch", "target")
    hop = branches.where("kind = 'alias'").select("snapshot", F.col("branch").alias("alias"), F.col("target").alias("branch")).join(direct, ["snapshot", "branch"]).select("snapshot", F.col("alias").alias("branch"), "target")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.regexp_replace("branch", "^refs/heads/", ""))
    usable = direct.unionByName(hop).withColumn("place", F.when(place > 0, place).otherwise(len(names) + 1))
    best = full.join(usable, "snapshot").groupBy("full_name").agg(F.min(F.struct("rank", "place", "branch", "snapshot", "target")).alias("b"))
    return best.select("full_name", "b.snapshot", "b.branch", "b.target")
