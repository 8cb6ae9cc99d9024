"""From source files to a calibrated index, as tables in a folder; a stage whose table is there and fresh is skipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.operators import calibrate, check, clusters, evidence, index, locate, prints, runs, structure, verify
from codekin.plans import report
from codekin.scratch import materialise
from codekin.sources.specs import Spec

STAGES = ("source", "print", "boiler", "clean", "edge", "repo", "pairs", "baseline", "null", "evidence", "meta")


@dataclass
class Corpus:
    """The tables of one project."""

    spark: SparkSession
    folder: str
    spec: Spec

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def stale(self, sources: DataFrame) -> bool:
        """Whether repositories came since the index was built."""
        if not self.has("repo"):
            return True
        return bool(sources.select("repo").distinct().join(self.read("repo").select(F.col("name").alias("repo")), "repo", "left_anti").limit(1).count())

    def _stage(self, name: str, build, before: list[bool]) -> DataFrame:
        """The stage's table: kept where it is finished and no earlier stage ran, else built anew."""
        if before[0] or not self.has(name):
            before[0] = True
            build().write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def build(self, sources: DataFrame, force: bool = False) -> bool:
        """Index and calibrate (repo, relpath, text); False if nothing had to be done. Repositories are keyed by name.

        A build that was broken off goes on at its first unfinished stage; with new repositories or ``force`` all stages run.
        """
        s = self.spec
        ran = [force or self.stale(sources)]
        texts = self._stage("source", lambda: sources.select("repo", "relpath", "text").where("repo is not null"), ran)
        p = self._stage("print", lambda: prints.winnow(texts, s.k, s.window).select("hash", "repo", "file", "line", "pos"), ran)
        names = texts.select(F.col("repo").alias("name")).distinct()
        boiler = self._stage("boiler", lambda: index.boilerplate(p, names, s.boiler_share), ran)
        clean = self._stage("clean", lambda: index.clean_sets(p, boiler), ran)
        edges = self._stage("edge", lambda: index.similarity_edges(clean, whole=True), ran)
        repo = self._stage("repo", lambda: self._repositories(names, clusters.representatives(index.set_sizes(clean), edges)), ran)
        reps = repo.where("representative = 1 and cluster is not null").select(F.col("name").alias("repo"))
        pairs = self._stage("pairs", lambda: index.pair_containment(index.buckets(clean.join(reps, "repo", "left_semi")), whole=True), ran)
        baseline = self._stage("baseline", lambda: calibrate.baseline_stats(pairs), ran)
        null = self._stage("null", lambda: calibrate.top_match_stats(materialise(calibrate.top_match(pairs, reps), "best")), ran)
        found = self._stage("evidence", lambda: evidence.ceilings(texts, reps), ran)
        self._stage("meta", lambda: self._meta(p, boiler, repo, baseline, null, found), ran)
        return ran[0]

    def _repositories(self, names: DataFrame, groups: DataFrame) -> DataFrame:
        return names.join(groups.withColumnRenamed("repo", "name"), "name", "left").withColumn("representative", F.coalesce("representative", F.lit(1)))

    def _meta(self, p: DataFrame, boiler: DataFrame, repo: DataFrame, baseline: DataFrame, null: DataFrame, found: DataFrame) -> DataFrame:
        """One typed row with the parameters, the sizes of the index and every null distribution."""
        s = self.spec
        one = repo.agg(F.count("*").alias("repos"), F.coalesce(F.sum("representative"), F.lit(0)).alias("representatives"), F.count_distinct("cluster").alias("clusters"))
        one = one.select(F.lit(s.k).alias("k"), F.lit(s.window).alias("w"), "*")
        parts = [boiler.agg(F.count("*").alias("boilerplate_prints")), p.where("hash is not null").select("hash").distinct().agg(F.count("*").alias("distinct_prints"))]
        parts += [baseline.select(*[F.col(c).alias(f"baseline_{c}") for c in baseline.columns]), null.select(*[F.col(c).alias(f"top_{c}") for c in null.columns]), found]
        for part in parts:
            one = one.crossJoin(F.broadcast(part))  # one row each
        return one

    def status(self) -> DataFrame:
        """(stage, finished, rows) in the order of the stages."""
        rows = [(i, n, self.has(n)) for i, n in enumerate(STAGES)]
        return self.spark.createDataFrame([(i, n, ok, self.read(n).count() if ok else None) for i, n, ok in rows], "at int, stage string, finished boolean, rows long").orderBy("at").drop("at")

    def resolved(self, submissions: DataFrame) -> DataFrame:
        """Submissions of a sub-project project that fail verification as they are, narrowed to their best directory; the others stay whole."""
        s = self.spec
        if s.module is None:
            return submissions
        files = submissions.select("repo", "relpath", "text")
        failed = materialise(verify.verify(files.where("relpath is not null"), s.rules).where("not ok").select("repo"), "failed")
        below = locate.below_best(files.join(failed, "repo", "left_semi"), s.module)
        return files.join(failed, "repo", "left_anti").unionByName(below.select("repo", "relpath", "text"))

    def check(self, submissions: DataFrame, handles: DataFrame | None = None, with_evidence: bool = True) -> DataFrame:
        """Ranked matches of submissions (repo, relpath, text) with their evidence channels; handles: (sub, handles array)."""
        s = self.spec
        submissions = materialise(self.resolved(submissions.select("repo", "relpath", "text")), "submissions")
        subs = prints.winnow(submissions, s.k, s.window).select(F.col("repo").alias("sub"), "hash").distinct().join(self.read("boiler"), "hash", "left_anti")
        clean = self.read("clean")
        scored = check.with_z(check.scores(subs, clean, index.set_sizes(clean)), self.read("null"), self.read("baseline"))
        if handles is not None:
            owner = F.split("repo", "/")[0]
            scored = scored.join(handles, "sub", "left").withColumn("self_match", check.self_match(owner, F.col("handles"))).drop("handles")
        ranked = check.top_matches(scored.withColumn("verdict", check.band(scored.columns)), s.top_n)
        if not with_evidence:
            return ranked
        return evidence.judged(ranked, submissions, self.read("source"), self.read("evidence"))

    def report(self, submissions: DataFrame, sub: str, matches: DataFrame, shown: int = 8) -> str:
        """An HTML page on one submission: cards, ranked matches, and the longest regions and common shapes of the first ``shown`` matches that aren't the submitter's own."""
        own = self.resolved(submissions.where(F.col("repo") == sub))
        ranked = materialise(matches.where(F.col("sub") == sub), "ranked")
        mine = F.col("self_match") if "self_match" in ranked.columns else F.lit(False)
        best = ranked.where(~mine & (F.coalesce("longest", F.lit(0)) > 0)).orderBy("rank").limit(shown)
        pairs = materialise(best.select(F.lit("s:").alias("a"), F.concat(F.lit("c:"), "repo").alias("b")), "shown")
        texts = own.select(F.lit("s:").alias("repo"), "relpath", "text").unionByName(self.read("source").select(F.concat(F.lit("c:"), "repo").alias("repo"), "relpath", "text").join(pairs.select(F.col("b").alias("repo")), "repo", "left_semi"))
        texts = materialise(texts, "texts")
        tokens = prints.file_tokens(texts)
        places = tokens.join(prints.offsets(tokens), ["repo", "relpath"]).select("repo", F.col("relpath").alias("file"), "offset", F.posexplode("toks").alias("p", "t")).select("repo", (F.col("offset") + F.col("p")).alias("pos"), "file", F.col("t.line").alias("line"))
        found = materialise(runs.regions(runs.top_runs(runs.maximal_runs(pairs, prints.kgrams(texts, runs.K, neighbours=True))), places), "regions")
        sides = [found.select(F.col(x).alias("repo"), F.col(f"{x}_file").alias("file"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end")) for x in ("a", "b")]
        lines = report.snippets(sides[0].unionByName(sides[1]), texts)
        shapes = structure.top_shapes(structure.shape_matches(structure.function_shapes(evidence.cpp_only(texts)), pairs))
        return report.page(sub, ranked, self.read("meta").first().asDict(), verify.line_counts(own).first(), found, lines, shapes)
