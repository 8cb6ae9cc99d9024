"""Queries over the driver's tables and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.functions.paths import language_of, selected
from codekin.functions.tokens import evidence_texts, normal_type, strip_cpp
from codekin.operators import calibrate, check, closest, clusters, discover, evidence as channel_evidence, hotkeys, index, locate, prints, runs, structure, verify
from codekin.plans import report
from codekin.scratch import discard, kept, materialise
from codekin.sources.tables import table

K, WINDOW = 25, 8
# The tables hold heads of files only: streams, shapes and signatures are shorter than in whole files, for scores and nulls alike.
STREAM, NODES, WEIGHT = 100, 8, 2
EVERY = 50  # submissions are the repositories whose id this divides, but for check_verdicts
TOP = 25  # matches that a submission's ranking lists
LEAST_EDGE = 0.15  # containment of repositories in one cluster
RULES = verify.Rules(min_files=3, min_lines=40, reject=["generated report"], required=["Server", "Client", "Channel", "Message", "Command"], required_threshold=1, required_weight=4, optional=["vector", "map", "string"], optional_weight=1, min_score=5)
MODULE = locate.Module(patterns=[r"(^|/)ex0[0-9](/|$)", r"(^|/)Modules(/|$)", r"(^|/)srcs?(/|$)"], required=["Form", "Bureaucrat", "Intern", "Server", "Client", "Channel"], optional=["Parser", "Message"], forbidden=["Zombie"], threshold=1, min_files=2)
EVENT_PARTS = ["ft_irc", "ircserv", "irc-server"]
EXCLUDED = [".git", "build", "vendor", "third_party", "node_modules", "cmake-build-debug"]


# ---- counts per key


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(table(spark, d, "print"), "hash", 0.01).select(F.col("key").alias("hash"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "print").where("hash is not null").distinct()


def p6_hash_counts(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_profile(_counted(spark, d), "hash", {"n_repos": ["repo"], "n_files": ["repo", "file"]}).withColumnRenamed("key", "hash")


def p6_repo_counts(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_profile(_counted(spark, d), "repo", {"n_hashes": ["hash"], "n_files": ["file"]}).withColumnRenamed("key", "repo")


def p6_pos_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_quantiles(_counted(spark, d), "hash", "pos", [0.5, 0.95]).select(F.col("key").alias("hash"), "q", "v")


# ---- tokens and prints


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = prints.file_tokens(table(spark, d, "source_files"))
    n = lambda w: F.size(F.filter("toks", lambda x: x["tok"] == w)).cast("long")
    return t.select("repo", "relpath", F.size("toks").cast("long").alias("n_tokens"), n("ID").alias("n_id"), n("LIT").alias("n_lit"))


def token_lines(spark: SparkSession, d: str) -> DataFrame:
    t = prints.file_tokens(table(spark, d, "source_files")).where("size(toks) > 0")
    lines = F.transform("toks", lambda x: x["line"])
    return t.select("repo", "relpath", F.size(F.array_distinct(lines)).cast("long").alias("lines"), F.array_max(lines).cast("long").alias("last_line"))


def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_files").withColumn("l", language_of(F.col("relpath"))).where("l != 'cpp'")
    t = prints.file_tokens(s).select(language_of(F.col("relpath")).alias("lang"), F.explode("toks").alias("t"))
    return t.groupBy("lang", F.col("t.tok").alias("tok")).agg(F.count("*").alias("n"))


def stripped_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_files").where("repo is not null and relpath is not null and text is not null").groupBy("repo", "relpath").agg(F.max("text").alias("text"))
    s = s.select("repo", "relpath", strip_cpp(F.col("text")).alias("s"))
    return s.select("repo", "relpath", F.length("s").cast("long").alias("length"), (F.length("s") - F.length(F.replace("s", F.lit("\n"), F.lit("")))).cast("long").alias("feeds"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "source_files").where("text is not null").select("repo", F.explode(evidence_texts(F.col("text"))).alias("evidence"))
    return t.groupBy("evidence").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


def language_classify(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "print").where("file is not null").select("repo", "file").distinct()
    return p.groupBy(F.coalesce(language_of(F.col("file")), F.lit("none")).alias("lang")).agg(F.count("*").alias("files"), F.countDistinct("repo").alias("repos"))


def wanted_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "print").where("repo is not null and file is not null").select("repo", "file").distinct()
    return p.where(selected(F.col("file"), [".cpp", ".hpp", ".h"], None, EXCLUDED)).groupBy("repo").agg(F.count("*").alias("files"))


def normal_types(spark: SparkSession, d: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^((?:const )?[a-zA-Z_:]+(?: [*&])?) [A-Za-z]+::[a-z]+\("), F.lit(1)))
    return table(spark, d, "source_files").select(found.alias("t")).groupBy(normal_type(F.col("t")).alias("type")).agg(F.count("*").alias("n"))


def kgram_counts(spark: SparkSession, d: str) -> DataFrame:
    g = prints.kgrams(table(spark, d, "source_files"), K)
    return g.groupBy("repo").agg(F.count("*").alias("grams"), F.countDistinct("hash").alias("distinct_grams"))


def winnow_prints(spark: SparkSession, d: str) -> DataFrame:
    return prints.winnow(table(spark, d, "source_files"), K, WINDOW)


def winnow_density(spark: SparkSession, d: str) -> DataFrame:
    return prints.density(table(spark, d, "source_files"), K, WINDOW)


# ---- index


def print_df(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequency(table(spark, d, "print"))


def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return index.boilerplate(table(spark, d, "print"), table(spark, d, "repo"))


def _stored(spark: SparkSession, d: str, name: str, build, tables: tuple[str, ...] = ("print", "repo")) -> DataFrame:
    """A table of the index over ``d``: built once, as an index is, and read by every query after that."""
    return kept(spark, [f"{d}/{t}.parquet" for t in tables], name, build)


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "clean", lambda: index.clean_sets(table(spark, d, "print"), boilerplate(spark, d)))


def clean_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    return index.set_sizes(_clean(spark, d))


def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return index.partners(_clean(spark, d))


def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "edges", lambda: index.similarity_edges(_clean(spark, d)))


def whole_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges beyond the cap of ``similarity_edges``, which is the cap of its SQL."""
    return index.similarity_edges(_clean(spark, d), whole=True)


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "clustered", lambda: clusters.representatives(index.set_sizes(_clean(spark, d)), similarity_edges(spark, d)))


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_sizes(cluster_members(spark, d))


def cluster_drift(spark: SparkSession, d: str) -> DataFrame:
    return clusters.old_against_new(cluster_members(spark, d), table(spark, d, "repo"))


# ---- calibration


def _representatives(spark: SparkSession, d: str) -> DataFrame:
    return cluster_members(spark, d).where("representative = 1").select("repo")


def _representative_pairs(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        sets = materialise(_clean(spark, d).join(_representatives(spark, d), "repo", "left_semi"), "sets")
        b = index.buckets(sets)
        discard(sets)
        return index.pair_containment(b)

    return _stored(spark, d, "pairs", build)


def baseline_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "baseline", lambda: calibrate.baseline_stats(_representative_pairs(spark, d)))


def top_match_null(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "best", lambda: calibrate.top_match(_representative_pairs(spark, d), _representatives(spark, d)))


def top_match_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "null", lambda: calibrate.top_match_stats(top_match_null(spark, d)))


# ---- submissions against the corpus


def _subs(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("repo") % EVERY == 0).select(F.col("repo").alias("sub"), "hash")


def check_shared(spark: SparkSession, d: str) -> DataFrame:
    clean = _clean(spark, d)
    s = check.shared_prints(_subs(clean), clean)
    return s.groupBy("sub").agg(F.count("*").alias("repos"), F.sum("shared").alias("shared"), F.max("shared").alias("most"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    clean = _clean(spark, d)
    scored = check.scores(_subs(clean), clean, index.set_sizes(clean))
    owners = table(spark, d, "repo").select(F.col("id").alias("repo"), "owner")
    handles = owners.where(F.col("repo") % EVERY == 0).select(F.col("repo").alias("sub"), F.array(F.upper("owner")).alias("handles"))
    scored = check.with_z(scored, top_match_stats(spark, d), baseline_stats(spark, d)).join(owners, "repo", "left").join(handles, "sub", "left")
    scored = scored.withColumn("self_match", check.self_match(F.col("owner"), F.col("handles"))).drop("handles", "owner")
    return scored.withColumn("verdict", check.band(scored.columns))


def check_top_matches(spark: SparkSession, d: str) -> DataFrame:
    return check.top_matches(_ranked(spark, d)).select("sub", "repo", "shared", "containment", "z", "self_match", "verdict", "rank")


def check_bands(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).groupBy("sub", "verdict").agg(F.count("*").alias("repos"))


def check_evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return check.evidence_gate(check.top_matches(_ranked(spark, d))).select("sub", "repo", "rank", "verdict")


def check_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every repository as a submission: its best matches with the verdict over all channels, clusters and ceilings without the cap; the other check queries take some submissions and stop at containment, as their SQL does."""
    sources = ("print", "repo", "source_files")
    clean = _clean(spark, d)
    best, links = closest.closest(index.buckets(clean), TOP, LEAST_EDGE)
    representatives = materialise(clusters.representatives(index.set_sizes(clean), links).where("representative = 1").select("repo"), "representatives")
    sets = materialise(clean.join(representatives, "repo", "left_semi"), "sets")
    null = materialise(calibrate.top_match_stats(materialise(calibrate.top_match(closest.closest(index.buckets(sets), 1)[0], representatives), "best")), "null")
    discard(sets)
    named = materialise(_named(spark, d), "named")
    found = _stored(spark, d, "ceilings", lambda: channel_evidence.ceilings(named, representatives, STREAM, NODES, WEIGHT), sources)
    owners = table(spark, d, "repo").select(F.col("id").alias("repo"), "owner")
    scored = check.with_z(best.withColumnsRenamed({"a": "sub", "b": "repo"}), null).join(owners, "repo", "left")
    scored = scored.join(owners.select(F.col("repo").alias("sub"), F.array("owner").alias("handles")), "sub", "left")
    scored = scored.withColumn("self_match", check.self_match(F.col("owner"), F.col("handles"))).drop("handles", "owner")
    ranked = check.top_matches(scored.withColumn("verdict", check.band(scored.columns)), TOP)
    out = channel_evidence.judged(ranked, None, named, found, NODES, WEIGHT)
    return out.select("sub", "repo", "rank", "containment", "longest", "ast_n", "ast_frac", "sig_n", "sig_frac", "verdict")


# ---- runs and evidence


def _named(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    ids = table(spark, d, "repo").select("id", "name")
    if pairs is not None:
        ids = ids.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    s = table(spark, d, "source_files")
    return s.join(ids, s["repo"] == ids["name"]).select(F.col("id").alias("repo"), "relpath", "text")


def _close_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity_edges(spark, d).where((F.col("a") % EVERY == 0) | (F.col("b") % EVERY == 0)).select("a", "b")


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = materialise(_close_pairs(spark, d), "close")
    s = _named(spark, d, pairs)
    return pairs, materialise(runs.maximal_runs(pairs, prints.kgrams(s, runs.K, neighbours=True)), "runs"), s


def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    pairs, found, _ = _runs(spark, d)
    return runs.longest_runs(pairs, found)


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, found, s = _runs(spark, d)
    t = prints.file_tokens(s)
    places = t.join(prints.offsets(t), ["repo", "relpath"]).select("repo", F.col("relpath").alias("file"), "offset", F.posexplode("toks").alias("p", "t")).select("repo", (F.col("offset") + F.col("p")).alias("pos"), "file", F.col("t.line").alias("line"))
    return runs.regions(runs.top_runs(found), places), s


def evidence_regions(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d)[0]


def evidence_snippets(spark: SparkSession, d: str) -> DataFrame:
    r, s = _regions(spark, d)
    return report.snippets(r.select(F.col("a").alias("repo"), F.col("a_file").alias("file"), F.col("a_start").alias("start"), F.col("a_end").alias("end")), s)


def run_null_stats(spark: SparkSession, d: str) -> DataFrame:
    return channel_evidence.run_null(_named(spark, d), _representatives(spark, d), STREAM)


# ---- verification and location


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("repo is not null and relpath is not null").groupBy("repo", "relpath").agg(F.max("text").alias("text"))


def verify_lines(spark: SparkSession, d: str) -> DataFrame:
    return verify.line_counts(_texts(spark, d))


def verify_hits(spark: SparkSession, d: str) -> DataFrame:
    return verify.token_hits(_texts(spark, d), RULES.required + RULES.optional)


def verify_score(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify(_texts(spark, d), RULES)


def makefile_name(spark: SparkSession, d: str) -> DataFrame:
    """On rows given here, as no table holds build files."""
    rows = spark.createDataFrame([(1, "NAME = ircserv\nall:"), (2, "CC=c++\nname:=bot \n"), (3, "NAME\t?= $(TARGET)"), (4, "all: NAMEX"), (5, "NAME += a b")], "id int, text string")
    return rows.select("id", verify.build_name(F.col("text")).alias("name"))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "print").where("repo is not null and file is not null").select("repo", F.col("file").alias("path")).distinct()


def locate_dirs(spark: SparkSession, d: str) -> DataFrame:
    return locate.candidate_dirs(_listing(spark, d), MODULE.patterns).groupBy("repo", "root").agg(F.count("*").alias("files"))


def locate_score(spark: SparkSession, d: str) -> DataFrame:
    return locate.score_dirs(locate.candidate_dirs(_listing(spark, d), MODULE.patterns), MODULE)


def locate_best(spark: SparkSession, d: str) -> DataFrame:
    return locate.locate(_listing(spark, d), MODULE)


# ---- discovery


def event_discovery(spark: SparkSession, d: str) -> DataFrame:
    return discover.from_events(table(spark, d, "github_events"), EVENT_PARTS, None, 2)


def event_delay(spark: SparkSession, d: str) -> DataFrame:
    return discover.late_events(table(spark, d, "github_events"))


def month_slices(spark: SparkSession, d: str) -> DataFrame:
    return discover.month_slices(spark, "2015-01", "2024-12")


def candidate_keep(spark: SparkSession, d: str) -> DataFrame:
    return discover.keep(table(spark, d, "candidates"), 40, 6000).select("cand_id", "full_name", "size")


def first_source_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    priority = F.when(F.col("batch_no") == 0, 0).when(F.col("found_by") == "gharchive", 1).otherwise(2)
    return discover.first_source_wins(c, priority, "cand_id").select("full_name", "cand_id", "found_by")


def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    return discover.todo(table(spark, d, "candidates"), table(spark, d, "repo"), "name").select("cand_id", "full_name")


def requeue_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return discover.requeue(table(spark, d, "candidates"), "found_by", ["TOPIC:", "docker"]).select("cand_id", "found_by")


def owner_expansion(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    seeds = table(spark, d, "repo").select(F.col("name").alias("full_name"))
    links = c.select("full_name", F.col("owner").alias("user"))
    return discover.expand_by_owners(seeds, links, c, [r"(?i)irc", r"(?i)cpp"]).select("cand_id", "full_name", "owner")


def newest_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "github_events").where("repo_name is not null").distinct()
    w = discover.newest(e.groupBy("repo_name", "created_at").agg(F.count("*").alias("n")), ["repo_name"], "created_at", 3)
    return w.select("repo_name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "rank")


def candidate_status(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.groupBy("batch_no").agg(F.count("*").alias("rows"), F.count("repo").alias("indexed"), F.count_if("fork").alias("forks"), F.count_if(F.col("size") == 0).alias("unsized"))


# ---- structure


def function_shapes(spark: SparkSession, d: str) -> DataFrame:
    return structure.function_shapes(table(spark, d, "source_files"))


def type_signatures(spark: SparkSession, d: str) -> DataFrame:
    return structure.type_signatures(table(spark, d, "source_files"))


def shape_scores(spark: SparkSession, d: str) -> DataFrame:
    return structure.channel_scores(materialise(structure.function_shapes(_named(spark, d), NODES), "shapes").withColumn("repo", F.col("repo").cast("long")), _close_pairs(spark, d), False)


def signature_scores(spark: SparkSession, d: str) -> DataFrame:
    return structure.channel_scores(materialise(structure.type_signatures(_named(spark, d), WEIGHT), "signatures").withColumn("repo", F.col("repo").cast("long")), _close_pairs(spark, d), True)


def shape_matches(spark: SparkSession, d: str) -> DataFrame:
    return structure.shape_matches(materialise(structure.function_shapes(_named(spark, d), NODES), "shapes").withColumn("repo", F.col("repo").cast("long")), _close_pairs(spark, d))


def channel_nulls(spark: SparkSession, d: str) -> DataFrame:
    return channel_evidence.channel_null(channel_evidence.cpp_only(_named(spark, d)), _representatives(spark, d), NODES, WEIGHT)[1]


def queries() -> dict:
    """Every query by name."""
    fs = (
        p6_found, p6_hash_counts, p6_repo_counts, p6_pos_quantiles, token_counts, token_lines, content_tokens, stripped_sizes, evidence, language_classify, wanted_paths, normal_types,
        kgram_counts, winnow_prints, winnow_density, print_df, boilerplate, clean_set_sizes, co_occurrence, similarity_edges, whole_edges, cluster_members, cluster_sizes, cluster_drift, baseline_stats,
        top_match_null, top_match_stats, check_shared, check_top_matches, check_bands, check_evidence_gate, check_verdicts, longest_runs, evidence_regions, evidence_snippets, run_null_stats, verify_lines,
        verify_hits, verify_score, makefile_name, locate_dirs, locate_score, locate_best, event_discovery, event_delay, month_slices, candidate_keep, first_source_wins, resume_todo,
        requeue_by_reason, owner_expansion, newest_events, candidate_status, function_shapes, type_signatures, shape_scores, signature_scores, shape_matches, channel_nulls,
    )
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    from codekin import oracle

    return oracle.sql()
