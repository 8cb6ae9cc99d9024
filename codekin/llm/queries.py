"""Queries and SQL of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.llm import groups, handwritten, history, leakage, packing, readlevel, setjoin, spans, termstats
from codekin.scratch import fresh_path, materialise
from codekin.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "print"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_report(table(spark, d, "print"), table(spark, d, "repo"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "print"), table(spark, d, "source_files"), table(spark, d, "repo"), table(spark, d, "boiler"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("repo", "file")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy("kind").agg(F.count("*").alias("files"), F.countDistinct("repo").alias("repos"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    join = setjoin.repository_pairs(table(spark, d, "print"), table(spark, d, "boiler"))
    return setjoin.expand_pairs(join).toDF("repo_a", "repo_b")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.link_counts(setjoin.repository_pairs(table(spark, d, "print"), table(spark, d, "boiler")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.first_matches(table(spark, d, "candidates"), table(spark, d, "print"), table(spark, d, "boiler"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.repository_groups(table(spark, d, "edges"), table(spark, d, "repo"))


def p5_assigned(spark: SparkSession, d: str) -> DataFrame:
    return groups.assign_all(table(spark, d, "edges"), table(spark, d, "repo"))


def _term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and repositories per hash: built from the repositories of batch 0, each later batch of candidates a delta."""
    terms = termstats.record_terms(table(spark, d, "print"), "hash", "repo", "file", ["line", "pos"])
    batches = table(spark, d, "candidates").select(F.col("repo").alias("record"), F.col("batch_no").alias("batch"))
    return termstats.by_batches(terms, batches, termstats.TermTable(spark, fresh_path(spark, "term_table"))).counts()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "repo").agg(F.count("*").alias("total"))
    return termstats.mark_terms(materialise(_term_counts(spark, d), "counts"), table(spark, d, "boiler").select("hash"), total).toDF("hash", "mark")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return _term_counts(spark, d).withColumnRenamed("term", "hash")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_pages(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.packed_pages(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    n = found.groupBy("item_id").agg(F.count("*").alias("pages"), F.max("words").alias("most_words"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("pages", F.lit(0)).alias("pages"), "most_words")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return readlevel.reading_bands(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return p10_found(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "band").agg(F.count("*").alias("pages"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_kinds, p3_found, p3_links, p4_found, p5_found, p5_assigned, p7_found, p7_counts, p8_packed, p8_fill, p9_found, p9_items, p10_found, p10_profile)}


SETS = "s AS (SELECT DISTINCT repo, hash FROM print WHERE hash IS NOT NULL AND repo IS NOT NULL AND hash NOT IN (SELECT hash FROM boiler WHERE hash IS NOT NULL)), z AS (SELECT repo, count(*) AS n FROM s GROUP BY repo)"
PAIRS = f"{SETS}, c AS (SELECT a.repo AS a, b.repo AS b, count(*) AS k FROM s a JOIN s b ON a.hash = b.hash AND a.repo < b.repo GROUP BY a.repo, b.repo), p AS (SELECT c.a, c.b FROM c JOIN z x ON x.repo = c.a JOIN z y ON y.repo = c.b WHERE 2 * k >= least(x.n, y.n))"
WINDOWS = """
r AS (SELECT DISTINCT repo, file, pos, hash FROM print WHERE hash IS NOT NULL AND repo IS NOT NULL AND file IS NOT NULL AND pos IS NOT NULL),
n AS (SELECT *, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY repo, file ORDER BY pos, hash)),
g AS (SELECT repo, file, i, count(*) OVER f AS k, list(hash) OVER f AS h FROM n WINDOW f AS (PARTITION BY repo, file ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
many AS (SELECT h FROM g WHERE k = 16 GROUP BY h HAVING count(DISTINCT (repo, file)) > 1),
hit AS (SELECT repo, file, i FROM g WHERE k = 16 AND h IN (SELECT h FROM many)),
c AS (SELECT DISTINCT repo, file, i + o AS i FROM hit, range(16) t(o)),
isl AS (SELECT repo, file, i, i - row_number() OVER (PARTITION BY repo, file ORDER BY i) AS grp FROM c),
sp AS (SELECT x.repo, x.file, min(n.pos) AS pos_from, max(n.pos) AS pos_to FROM isl x JOIN n ON n.repo = x.repo AND n.file = x.file AND n.i = x.i GROUP BY x.repo, x.file, x.grp)"""
GROUPS = """
l AS (SELECT src AS a, dst AS b FROM edges WHERE containment >= 0.15 AND NOT isnan(containment) AND src <> dst AND src IN (SELECT id FROM repo) AND dst IN (SELECT id FROM repo)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w AS (SELECT a AS id, a AS m FROM u UNION SELECT w.id, u.b FROM w JOIN u ON u.a = w.m),
gr AS (SELECT id, min(m) AS group_id FROM w GROUP BY id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {WINDOWS} SELECT repo, file, pos_from, pos_to FROM sp",
        "p1_report": f"""WITH {WINDOWS},
            q AS (SELECT repo, file, count(*) AS spans, sum(pos_to - pos_from + 1) AS shared_tokens FROM sp GROUP BY repo, file),
            f AS (SELECT repo, file, CAST(max(pos) + 1 AS BIGINT) AS file_tokens FROM r GROUP BY repo, file),
            t AS (SELECT f.repo, greatest(sum(file_tokens), coalesce(max(tokens), 0)) AS repo_tokens FROM f LEFT JOIN repo ON repo.id = f.repo GROUP BY f.repo)
            SELECT f.repo, f.file, CAST(coalesce(spans, 0) AS BIGINT) AS spans, CAST(coalesce(shared_tokens, 0) AS BIGINT) AS shared_tokens, file_tokens, CAST(repo_tokens AS BIGINT) AS repo_tokens, CAST(coalesce(shared_tokens, 0) AS DOUBLE) / file_tokens AS file_share, CAST(coalesce(shared_tokens, 0) AS DOUBLE) / repo_tokens AS repo_share
            FROM f JOIN t ON t.repo = f.repo LEFT JOIN q ON q.repo = f.repo AND q.file = f.file""",
        "p3_found": f"WITH {PAIRS} SELECT a AS repo_a, b AS repo_b FROM p",
        "p3_links": f"""WITH {PAIRS}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), k AS (SELECT a, count(*) AS links FROM e GROUP BY a),
            f AS (SELECT repo, list(hash ORDER BY hash) AS h FROM s GROUP BY repo)
            SELECT f.repo AS id, min(f.repo) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS members, coalesce(links, 0) AS links FROM f LEFT JOIN k ON k.a = f.repo""",
        "p4_found": f"""WITH {PAIRS}, k AS (SELECT cand_id, batch_no, repo,
                nullif(lower(regexp_replace(regexp_replace(trim(full_name), '/+$', ''), '\\.git$', '', 'i')), '') AS nk,
                nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(clone_url)), '^[a-z+]+://', ''), '^[^/@]+@', ''), '^www\\.', ''), '^([^/:]+):([0-9]+/)?/*', '\\1/'), '(\\.git)?[/?#]*$', ''), '') AS uk FROM candidates WHERE cand_id IS NOT NULL AND batch_no IS NOT NULL),
            l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
            m AS (SELECT c.cand_id, e.cand_id AS first_id FROM k c JOIN k e ON c.nk = e.nk AND (e.batch_no, e.cand_id) < (c.batch_no, c.cand_id) WHERE c.batch_no >= 1
              UNION ALL SELECT c.cand_id, e.cand_id FROM k c JOIN k e ON c.uk = e.uk AND (e.batch_no, e.cand_id) < (c.batch_no, c.cand_id) WHERE c.batch_no >= 1
              UNION ALL SELECT c.cand_id, e.cand_id FROM k c JOIN l ON l.a = c.repo JOIN k e ON e.repo = l.b AND (e.batch_no, e.cand_id) < (c.batch_no, c.cand_id) WHERE c.batch_no >= 1)
            SELECT min(first_id) AS first_id, cand_id FROM m GROUP BY cand_id""",
        "p5_found": f"WITH RECURSIVE {GROUPS} SELECT id, group_id FROM gr",
        "p5_assigned": f"WITH RECURSIVE {GROUPS} SELECT repo.id, coalesce(group_id, repo.id) AS group_id, cluster AS old_cluster, count(*) OVER (PARTITION BY coalesce(group_id, repo.id)) AS members FROM repo LEFT JOIN gr ON gr.id = repo.id",
        "p7_found": """WITH k AS (SELECT hash, count(DISTINCT repo) AS n FROM print WHERE hash IS NOT NULL AND repo IS NOT NULL GROUP BY hash)
            SELECT hash, 'common' AS mark FROM k WHERE n >= 0.25 * (SELECT count(*) FROM repo)
            UNION ALL SELECT b.hash, 'rare' AS mark FROM (SELECT DISTINCT hash FROM boiler WHERE hash IS NOT NULL) b LEFT JOIN k ON k.hash = b.hash WHERE coalesce(n, 0) < 2""",
        "p7_counts": "SELECT hash, count(DISTINCT (repo, file, line, pos)) AS n_rows, count(DISTINCT repo) AS n_records FROM print WHERE hash IS NOT NULL AND repo IS NOT NULL GROUP BY hash",
    }
