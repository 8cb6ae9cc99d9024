"""The SQL that queries are compared with; written for an engine with RE2 patterns and list functions."""

from __future__ import annotations

from codekin.functions.paths import NAMES, SUFFIXES
from codekin.functions.tokens import CONTENT_TOKEN, CPP_KEYWORDS, CPP_TOKEN, DOCKER_WORDS, SHELL_WORDS
from codekin.queries import EVENT_PARTS, EVERY, EXCLUDED, MODULE, RULES, STREAM, WINDOW, K


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _language(path: str) -> str:
    base = f"lower(regexp_extract({path}, '[^/]*$'))"
    names = " ".join(f"WHEN {base} IN {_in([k for k, v in NAMES.items() if v == lang])} THEN '{lang}'" for lang in dict.fromkeys(NAMES.values()))
    ends = " ".join("WHEN " + " OR ".join(f"ends_with({base}, '{s}')" for s in ss) + f" THEN '{lang}'" for lang, ss in SUFFIXES.items())
    return f"CASE {names} WHEN starts_with({base}, 'dockerfile') OR ends_with({base}, '.dockerfile') THEN 'dockerfile' WHEN starts_with({base}, 'makefile') THEN 'make' {ends} END"


BLOCK = r"'(?s)/\*.*?\*/'"
STRIPPED = rf"""regexp_replace(regexp_replace(regexp_replace(
    array_to_string(list_transform(list_zip(regexp_split_to_array(text, {BLOCK}), regexp_extract_all(text, {BLOCK})), lambda z: coalesce(z[1], '') || repeat(chr(10), length(coalesce(z[2], '')) - length(replace(coalesce(z[2], ''), chr(10), '')))), ''),
    '//[^\n]*', '', 'g'), '"(?:\\[^\n]|[^"\\])*"', '"S"', 'g'), '''(?:\\[^\n]|[^''\\])*''', '''C''', 'g')"""
HASHED = r"regexp_replace(text, '(^|[^\\])#[^\n]*', '\1', 'g')"
FILES = f"f AS (SELECT repo, relpath, max(text) AS text, {_language('relpath')} AS lang FROM source_files WHERE repo IS NOT NULL AND relpath IS NOT NULL AND text IS NOT NULL GROUP BY repo, relpath)"
# Patterns are constants in either branch, so the engine compiles them once.
TOKENS = rf"""{FILES},
    sp AS MATERIALIZED (SELECT repo, relpath, lang, string_split({STRIPPED}, chr(10)) AS rows FROM f WHERE coalesce(lang, 'cpp') = 'cpp' UNION ALL SELECT repo, relpath, lang, string_split({HASHED}, chr(10)) FROM f WHERE coalesce(lang, 'cpp') <> 'cpp'),
    ls AS MATERIALIZED (SELECT repo, relpath, coalesce(lang, 'cpp') AS lang, unnest(rows) AS row, generate_subscripts(rows, 1) AS line FROM sp),
    tl AS MATERIALIZED (SELECT repo, relpath, lang, line, regexp_extract_all(row, {_q(CPP_TOKEN)}) AS t FROM ls WHERE lang = 'cpp' UNION ALL SELECT repo, relpath, lang, line, regexp_extract_all(row, {_q(CONTENT_TOKEN)}) FROM ls WHERE lang <> 'cpp'),
    ts AS MATERIALIZED (SELECT repo, relpath, lang, line, unnest(t) AS t, generate_subscripts(t, 1) AS o FROM tl),
    tk AS MATERIALIZED (SELECT repo, relpath, lang, line, o, CASE WHEN lang = 'cpp' THEN
            CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN CASE WHEN t IN {_in(CPP_KEYWORDS)} THEN t ELSE 'ID' END WHEN regexp_matches(t, '^\p{{Nd}}') THEN 'LIT' ELSE t END
          ELSE CASE WHEN starts_with(t, '$') THEN '$VAR' WHEN regexp_matches(t, '^\p{{Nd}}') THEN 'NUM' WHEN lang = 'dockerfile' AND lower(t) IN {_in(DOCKER_WORDS)} THEN upper(t)
            WHEN lang = 'shell' AND lower(t) IN {_in(SHELL_WORDS)} THEN lower(t) WHEN regexp_matches(t, '^[A-Za-z_]') THEN lower(t) ELSE t END END AS tok FROM ts)"""
HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


def _grams(k: int, repo: str = "repo") -> str:
    return f"""st AS MATERIALIZED (SELECT {repo} AS repo, relpath AS file, line, tok, row_number() OVER (PARTITION BY repo ORDER BY relpath, line, o) - 1 AS pos FROM tk),
    gr AS (SELECT repo, pos, file, line, {HASH.format("array_to_string(list(tok) OVER w, ' ')")} AS hash, count(*) OVER w AS c FROM st WINDOW w AS (PARTITION BY repo ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)),
    g AS MATERIALIZED (SELECT repo, pos, file, line, hash FROM gr WHERE c = {k})"""


WINNOW = f"""{TOKENS}, {_grams(K)},
    n AS (SELECT repo, count(*) AS n FROM g GROUP BY repo),
    wi AS (SELECT g.repo, g.pos, min((hash, pos)) OVER (PARTITION BY g.repo ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m, n FROM g JOIN n ON n.repo = g.repo),
    wp AS (SELECT DISTINCT repo, m[1] AS hash, m[2] AS pos FROM wi WHERE pos < greatest(1, n - {WINDOW} + 1)),
    pr AS (SELECT wp.repo, wp.hash, g.file, g.line, wp.pos FROM wp JOIN g ON g.repo = wp.repo AND g.pos = wp.pos)"""

SETS = """rs AS (SELECT DISTINCT repo, hash FROM print WHERE hash IS NOT NULL AND repo IS NOT NULL),
    df AS (SELECT hash, count(*) AS df FROM rs GROUP BY hash),
    bo AS (SELECT hash FROM df WHERE df >= 0.25 * (SELECT count(*) FROM repo)),
    cs AS (SELECT repo, hash FROM rs WHERE hash NOT IN (SELECT hash FROM bo)),
    sz AS (SELECT repo, count(*) AS n FROM cs GROUP BY repo)"""


def _pairs(of: str, name: str) -> str:
    """Co-occurring pairs of the sets ``of`` with full intersections."""
    return f"""{name}b AS (SELECT hash FROM {of} GROUP BY hash HAVING count(*) BETWEEN 2 AND 200),
    {name}c AS (SELECT DISTINCT x.repo AS a, y.repo AS b FROM {of} x JOIN {of} y ON x.hash = y.hash AND x.repo < y.repo WHERE x.hash IN (SELECT hash FROM {name}b)),
    {name}s AS (SELECT x.repo AS a, y.repo AS b, count(*) AS shared FROM {of} x JOIN {of} y ON x.hash = y.hash AND x.repo < y.repo GROUP BY x.repo, y.repo),
    {name} AS (SELECT c.a, c.b, s.shared, CAST(s.shared AS DOUBLE) / least(u.n, v.n) AS containment FROM {name}c c JOIN {name}s s ON s.a = c.a AND s.b = c.b JOIN sz u ON u.repo = c.a JOIN sz v ON v.repo = c.b)"""


EDGES = f"{SETS}, {_pairs('cs', 'pa')}, ed AS (SELECT * FROM pa WHERE containment >= 0.15)"
CLUSTERS = f"""{EDGES}, ud AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
    wk AS (SELECT repo AS id, repo AS m FROM sz UNION SELECT wk.id, ud.b FROM wk JOIN ud ON ud.a = wk.m),
    cl AS (SELECT id AS repo, min(m) AS cluster FROM wk GROUP BY id),
    ck AS (SELECT cl.repo, cluster, n, count(*) OVER (PARTITION BY cluster) AS members, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cl.repo) AS r FROM cl JOIN sz ON sz.repo = cl.repo)"""
REPS = f"{CLUSTERS}, cr AS (SELECT cs.repo, cs.hash FROM cs JOIN ck ON ck.repo = cs.repo AND ck.r = 1), {_pairs('cr', 'pb')}"
BEST = f"""{REPS}, bm AS (SELECT ck.repo, coalesce(max(containment), CAST(0 AS DOUBLE)) AS best FROM ck LEFT JOIN (SELECT a AS repo, containment FROM pb UNION ALL SELECT b, containment FROM pb) x ON x.repo = ck.repo WHERE ck.r = 1 GROUP BY ck.repo),
    br AS (SELECT best, row_number() OVER (ORDER BY best) - 1 AS i, count(*) OVER () AS n FROM bm)"""


def _pick(table: str, value: str, p: str, n: str = "n") -> str:
    return f"(SELECT CAST({value} AS DOUBLE) FROM {table} WHERE i = least(CAST(floor(CAST({p} AS DOUBLE) * {n}) AS BIGINT), {n} - 1))"


NULL = f"""{BEST}, nu AS (SELECT count(*) AS n, round(avg(best), 9) AS mean, round(stddev_pop(best), 9) AS stdev, max(best) AS max, {_pick('br', 'best', '0.5')} AS p50, {_pick('br', 'best', '0.95')} AS p95, {_pick('br', 'best', '0.99')} AS p99 FROM bm)"""
SHARED = f"sh AS (SELECT s.repo AS sub, c.repo AS repo, count(*) AS shared FROM cs s JOIN cs c ON c.hash = s.hash AND c.repo <> s.repo WHERE s.repo % {EVERY} = 0 GROUP BY s.repo, c.repo)"
RANKED = f"""{NULL}, {SHARED},
    sc AS (SELECT sh.sub, sh.repo, sh.shared, CAST(shared AS DOUBLE) / least(u.n, v.n) AS containment FROM sh JOIN sz u ON u.repo = sh.sub JOIN sz v ON v.repo = sh.repo),
    sv AS (SELECT sc.sub, sc.repo, shared, containment, (containment - mean) / coalesce(nullif(stdev, 0), 1e-9) AS z, coalesce(lower(o.owner) = lower(h.owner), false) AS self_match, p99 FROM sc, nu, repo o, repo h WHERE o.id = sc.repo AND h.id = sc.sub),
    ve AS (SELECT *, CASE WHEN self_match THEN 'SELF' WHEN containment >= greatest(CAST(0.30 AS DOUBLE), CAST(2.5 AS DOUBLE) * p99) THEN 'HIGH' WHEN containment >= greatest(CAST(0.18 AS DOUBLE), CAST(1.5 AS DOUBLE) * p99) THEN 'MEDIUM' WHEN containment >= p99 THEN 'LOW' ELSE 'NORMAL' END AS verdict FROM sv),
    rk AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY containment DESC, repo) AS rank FROM ve)"""
NAMED_TOKENS = TOKENS.replace("FROM source_files WHERE", "FROM (SELECT repo.id AS repo, relpath, text FROM source_files s JOIN repo ON repo.name = s.repo) WHERE")
PAIRED_TOKENS = NAMED_TOKENS.replace("ON repo.name = s.repo)", "ON repo.name = s.repo WHERE repo.id IN (SELECT a FROM cp UNION SELECT b FROM cp))")
RUNS = f"""{EDGES}, cp AS MATERIALIZED (SELECT a, b FROM ed WHERE a % {EVERY} = 0 OR b % {EVERY} = 0), {PAIRED_TOKENS}, {_grams(12)},
    se AS (SELECT a, b, x.pos AS i, y.pos AS j FROM cp JOIN g x ON x.repo = a JOIN g y ON y.repo = b AND y.hash = x.hash),
    ru AS (SELECT a, b, min(i) AS i, min(j) AS j, count(*) + 11 AS tokens FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS isl FROM se) q GROUP BY a, b, i - j, isl),
    rr AS (SELECT * FROM ru WHERE tokens >= 20),
    rt AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY tokens DESC, i DESC, j DESC) AS rank FROM rr),
    rg AS (SELECT a, b, tokens, p.file AS a_file, p.line AS a_start, q.line AS a_end, r.file AS b_file, r.line AS b_start, s.line AS b_end FROM rt
      JOIN st p ON p.repo = a AND p.pos = rt.i JOIN st q ON q.repo = a AND q.pos = rt.i + tokens - 1 JOIN st r ON r.repo = b AND r.pos = rt.j JOIN st s ON s.repo = b AND s.pos = rt.j + tokens - 1 WHERE rank <= 5)"""
TEXTS = "tx AS (SELECT repo, relpath, max(text) AS text FROM source_files WHERE repo IS NOT NULL AND relpath IS NOT NULL GROUP BY repo, relpath)"
STEM = r"CASE WHEN regexp_matches(path, '\.(hpp|cpp|h|tpp|ipp|hh|cc)$') THEN regexp_replace(regexp_extract(path, '[^/]*$'), '\.(hpp|cpp|h|tpp|ipp|hh|cc)$', '') END"
_HIT = " ".join(f"WHEN regexp_matches(path, {_q(p)}) THEN {i}" for i, p in enumerate(MODULE.patterns))
_MATCH = " ".join(f"WHEN {i} THEN regexp_extract(path, {_q(p)})" for i, p in enumerate(MODULE.patterns))
DIRS = rf"""li AS (SELECT DISTINCT repo, regexp_replace(replace(file, '\', '/'), '^/+|/+$', '', 'g') AS path FROM print WHERE repo IS NOT NULL AND file IS NOT NULL),
    l0 AS (SELECT DISTINCT repo, file FROM print WHERE repo IS NOT NULL AND file IS NOT NULL),
    l1 AS (SELECT repo, regexp_replace(replace(file, '\', '/'), '^/+|/+$', '', 'g') AS path FROM l0),
    lh AS (SELECT repo, path, CASE {_HIT} END AS hit FROM l1),
    lm AS (SELECT repo, path, CASE hit {_MATCH} END AS m FROM lh WHERE hit IS NOT NULL),
    le AS (SELECT repo, path, greatest(strpos(path, m) + length(m) - 1, 1) AS e FROM lm),
    dr AS (SELECT repo, path, CASE WHEN strpos(substr(path, e), '/') > 0 THEN substr(path, 1, e + strpos(substr(path, e), '/') - 2) ELSE regexp_replace(path, '/?[^/]*$', '') END AS root FROM le)"""


def _scored(of: str, root: str) -> str:
    n = lambda names: f"count(DISTINCT CASE WHEN {STEM} IN {_in(names)} THEN {STEM} END)"
    src = " OR ".join(f"ends_with(path, '{s}')" for s in SUFFIXES["cpp"])
    return f"""SELECT repo, {root} AS root, {n(MODULE.required)} AS hits, {n(MODULE.optional)} AS supporting, {n(MODULE.forbidden)} AS foreign_hits, count(*) FILTER (WHERE {src}) AS sources FROM {of} GROUP BY repo, {root}"""


_SCORE = f"CASE WHEN hits >= {MODULE.threshold} AND foreign_hits = 0 AND sources >= {MODULE.min_files} THEN hits * 3 + supporting ELSE 0 END AS score"
WORDS = RULES.required + RULES.optional
_count = lambda ws: " + ".join(rf"max(CAST(coalesce(regexp_matches(text, '\b{w}\b'), false) AS INT))" for w in ws)


def sql() -> dict[str, str]:
    d = "WITH d AS (SELECT DISTINCT * FROM print WHERE hash IS NOT NULL)"
    own = "SELECT DISTINCT repo, file FROM print WHERE file IS NOT NULL"
    return {
        "p6_found": "SELECT hash FROM print WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) >= 0.01 * (SELECT count(hash) FROM print)",
        "p6_hash_counts": f"{d} SELECT hash, count(*) AS n_rows, count(DISTINCT repo) AS n_repos, count(DISTINCT CASE WHEN repo IS NOT NULL AND file IS NOT NULL THEN (repo, file) END) AS n_files FROM d GROUP BY hash",
        "p6_repo_counts": f"{d} SELECT repo, count(*) AS n_rows, count(DISTINCT hash) AS n_hashes, count(DISTINCT file) AS n_files FROM d WHERE repo IS NOT NULL GROUP BY repo",
        "p6_pos_quantiles": f"{d}, r AS (SELECT hash, pos, row_number() OVER (PARTITION BY hash ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY hash) AS n FROM d WHERE pos IS NOT NULL) SELECT hash, q, CAST(pos AS BIGINT) AS v FROM r, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) t(q) WHERE i = least(CAST(floor(q * n) AS BIGINT), n - 1)",
        "token_counts": f"WITH {TOKENS} SELECT f.repo, f.relpath, count(tok) AS n_tokens, count(*) FILTER (WHERE tok = 'ID') AS n_id, count(*) FILTER (WHERE tok = 'LIT') AS n_lit FROM f LEFT JOIN tk ON tk.repo = f.repo AND tk.relpath = f.relpath GROUP BY f.repo, f.relpath",
        "token_lines": f"WITH {TOKENS} SELECT repo, relpath, count(DISTINCT line) AS lines, max(line) AS last_line FROM tk GROUP BY repo, relpath",
        "content_tokens": f"WITH {TOKENS} SELECT lang, tok, count(*) AS n FROM tk WHERE lang <> 'cpp' GROUP BY lang, tok",
        "stripped_sizes": f"WITH {FILES}, s AS (SELECT repo, relpath, {STRIPPED} AS s FROM f) SELECT repo, relpath, length(s) AS length, length(s) - length(replace(s, chr(10), '')) AS feeds FROM s",
        "evidence": r"""WITH s AS (SELECT repo, text FROM source_files WHERE text IS NOT NULL), e AS (
            SELECT repo, trim(unnest(regexp_extract_all(text, '//([^\n]*)', 1))) AS evidence FROM s
            UNION ALL SELECT repo, trim(regexp_replace(unnest(regexp_extract_all(text, '(?s)/\*(.*?)\*/', 1)), '\s+', ' ', 'g')) FROM s
            UNION ALL SELECT repo, unnest(regexp_extract_all(text, '"(?:\\[^\n]|[^"\\])*"')) FROM s)
            SELECT evidence, count(*) AS n, count(DISTINCT repo) AS repos FROM e WHERE length(evidence) >= 12 GROUP BY evidence""",
        "language_classify": f"WITH p AS ({own}) SELECT coalesce({_language('file')}, 'none') AS lang, count(*) AS files, count(DISTINCT repo) AS repos FROM p GROUP BY 1",
        "wanted_paths": f"""WITH p AS ({own} AND repo IS NOT NULL), s AS (SELECT repo, file, string_split(file, '/') AS g FROM p)
            SELECT repo, count(*) AS files FROM s WHERE (ends_with(file, '.cpp') OR ends_with(file, '.hpp') OR ends_with(file, '.h')) AND len(list_filter(g[1:len(g) - 1], lambda x: x IN {_in(EXCLUDED)} OR (starts_with(x, '.') AND x NOT IN ('.', '..')))) = 0 GROUP BY repo""",
        "normal_types": r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '(?m)^((?:const )?[a-zA-Z_:]+(?: [*&])?) [A-Za-z]+::[a-z]+\(', 1)) AS t FROM source_files),
            u AS (SELECT replace(replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(t, '\s+', ' ', 'g')), 'const ', ''), 'static ', ''), 'inline ', ''), 'virtual ', ''), 'unsigned ', ''), 'struct ', ''), 'class ', ''), 'typename ', '') AS t FROM t),
            v AS (SELECT trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '& ', '&'), '* ', '*'), ' &', '&'), ' *', '*'), 'std::size_t', 'size_t'), 'long long', 'long'), 'uint32_t', 'int'), 'int32_t', 'int'), 'short', 'int')) AS type FROM u) SELECT type, count(*) AS n FROM v GROUP BY type""",
        "kgram_counts": f"WITH {TOKENS}, {_grams(K)} SELECT repo, count(*) AS grams, count(DISTINCT hash) AS distinct_grams FROM g GROUP BY repo",
        "winnow_prints": f"WITH {WINNOW} SELECT repo, hash, file, line, pos FROM pr",
        "winnow_density": f"WITH {WINNOW}, a AS (SELECT count(*) AS tokens FROM st), b AS (SELECT count(*) AS grams FROM g), c AS (SELECT count(*) AS prints FROM pr) SELECT tokens, grams, prints, CAST(prints AS DOUBLE) / grams AS prints_per_gram FROM a, b, c",
        "print_df": f"WITH {SETS} SELECT hash, df FROM df",
        "boilerplate": f"WITH {SETS} SELECT hash FROM bo",
        "clean_set_sizes": f"WITH {SETS} SELECT repo, n FROM sz",
        "co_occurrence": f"WITH {SETS}, {_pairs('cs', 'pa')} SELECT repo, count(*) AS partners FROM (SELECT a AS repo FROM pa UNION ALL SELECT b FROM pa) x GROUP BY repo",
        "similarity_edges": f"WITH {EDGES} SELECT a, b, shared, containment FROM ed",
        "cluster_members": f"WITH RECURSIVE {CLUSTERS} SELECT repo, cluster, members, CAST(r = 1 AS INT) AS representative FROM ck",
        "cluster_sizes": f"WITH RECURSIVE {CLUSTERS} SELECT members, count(DISTINCT cluster) AS clusters FROM ck GROUP BY members",
        "cluster_drift": f"WITH RECURSIVE {CLUSTERS} SELECT ck.repo, ck.cluster, CASE WHEN repo.cluster IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY ck.cluster, repo.cluster) END AS old_members FROM ck JOIN repo ON repo.id = ck.repo",
        "baseline_stats": f"WITH RECURSIVE {REPS}, pr AS (SELECT containment, row_number() OVER (ORDER BY containment) - 1 AS i, count(*) OVER () AS n FROM pb) SELECT count(*) AS pairs, round(avg(containment), 9) AS mean, round(stddev_pop(containment), 9) AS stdev, max(containment) AS max, {_pick('pr', 'containment', '0.95')} AS p95 FROM pb",
        "top_match_null": f"WITH RECURSIVE {BEST} SELECT repo, best FROM bm",
        "top_match_stats": f"WITH RECURSIVE {NULL} SELECT * FROM nu",
        "check_shared": f"WITH {SETS}, {SHARED} SELECT sub, count(*) AS repos, CAST(sum(shared) AS BIGINT) AS shared, max(shared) AS most FROM sh GROUP BY sub",
        "check_top_matches": f"WITH RECURSIVE {RANKED} SELECT sub, repo, shared, containment, z, self_match, verdict, rank FROM rk WHERE rank <= 25",
        "check_bands": f"WITH RECURSIVE {RANKED} SELECT sub, verdict, count(*) AS repos FROM ve GROUP BY sub, verdict",
        "check_evidence_gate": f"WITH RECURSIVE {RANKED} SELECT sub, repo, rank, verdict FROM rk WHERE rank <= 25 AND (verdict <> 'NORMAL' OR rank <= 6)",
        "longest_runs": f"WITH {RUNS} SELECT cp.a, cp.b, coalesce(max(tokens), 0) AS longest FROM cp LEFT JOIN rr ON rr.a = cp.a AND rr.b = cp.b GROUP BY cp.a, cp.b",
        "evidence_regions": f"WITH {RUNS} SELECT * FROM rg",
        "evidence_snippets": f"""WITH {RUNS}, rd AS (SELECT DISTINCT a AS repo, a_file AS file, a_start AS start_line, a_end AS end_line FROM rg),
            rl AS (SELECT rd.*, string_split(text, chr(10)) AS ls FROM rd JOIN f ON f.repo = rd.repo AND f.relpath = rd.file),
            rn AS (SELECT repo, file, start_line, end_line, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM rl)
            SELECT repo, file, start_line AS start, end_line AS "end", line, text, line BETWEEN start_line AND end_line AS marked FROM rn WHERE line BETWEEN start_line - 3 AND end_line + 3""",
        "run_null_stats": f"""WITH RECURSIVE {CLUSTERS}, {NAMED_TOKENS}, {_grams(12)}, rp AS MATERIALIZED (SELECT repo FROM ck WHERE r = 1 AND repo IN (SELECT repo FROM st)),
            sm AS (SELECT repo FROM rp ORDER BY md5('42|' || repo), repo LIMIT 90),
            ln AS (SELECT repo FROM st WHERE repo IN (SELECT repo FROM sm) GROUP BY repo HAVING count(*) > {STREAM}),
            pq AS (SELECT x.repo AS a, y.repo AS b FROM ln x, ln y WHERE x.repo < y.repo ORDER BY md5('42|' || x.repo || '|' || y.repo), 1, 2 LIMIT 400),
            se AS (SELECT a, b, x.pos AS i, y.pos AS j FROM pq JOIN g x ON x.repo = a JOIN g y ON y.repo = b AND y.hash = x.hash),
            ru AS (SELECT a, b, count(*) + 11 AS tokens FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS isl FROM se) q GROUP BY a, b, i - j, isl),
            lo AS (SELECT pq.a, pq.b, coalesce(max(tokens), 0) AS longest FROM pq LEFT JOIN ru ON ru.a = pq.a AND ru.b = pq.b GROUP BY pq.a, pq.b),
            lr AS (SELECT longest, row_number() OVER (ORDER BY longest) - 1 AS i, count(*) OVER () AS n FROM lo),
            ou AS (SELECT count(*) AS pairs, CAST(max(longest) AS DOUBLE) AS max, {_pick('lr', 'longest', '0.5')} AS median, {_pick('lr', 'longest', '0.95')} AS p95, {_pick('lr', 'longest', '0.99')} AS p99, {_pick('lr', 'longest', '(SELECT 1 - CAST(1 AS DOUBLE) / greatest(count(*), 2) FROM rp)')} AS expected_top FROM lo)
            SELECT *, CAST(least(greatest(floor(expected_top * CAST(1.2 AS DOUBLE)), 250), greatest(floor(p99 * 2), 400)) AS BIGINT) AS threshold FROM ou""",
        "verify_lines": f"WITH {TEXTS} SELECT repo, count(*) AS files, CAST(sum(coalesce(length(text) - length(replace(text, chr(10), '')), 0)) AS BIGINT) AS lines FROM tx GROUP BY repo",
        "verify_hits": f"WITH {TEXTS}, h AS (" + " UNION ALL ".join(rf"SELECT repo, '{w}' AS word FROM tx WHERE regexp_matches(text, '\b{w}\b')" for w in WORDS) + ") SELECT repo, word, count(*) AS files FROM h GROUP BY repo, word",
        "verify_score": f"""WITH {TEXTS}, v AS (SELECT repo, count(*) AS files, CAST(sum(coalesce(length(text) - length(replace(text, chr(10), '')), 0)) AS BIGINT) AS lines, {_count(RULES.required)} AS found, {_count(RULES.optional)} AS supporting, max(CAST(coalesce(contains(text, '{RULES.reject[0]}'), false) AS INT)) AS bad FROM tx GROUP BY repo),
            e AS (SELECT *, CASE WHEN files < {RULES.min_files} THEN 'too few source files' WHEN lines < {RULES.min_lines} THEN 'too few lines' WHEN bad = 1 THEN 'reject token {RULES.reject[0]}' WHEN found < {RULES.required_threshold} THEN 'only ' || found || '/{RULES.required_threshold} required tokens' END AS early FROM v),
            s AS (SELECT *, CASE WHEN early IS NOT NULL THEN 0 ELSE CASE WHEN found > 0 THEN {RULES.required_weight} ELSE 0 END + CASE WHEN supporting > 0 THEN {RULES.optional_weight} ELSE 0 END END AS score FROM e)
            SELECT repo, early IS NULL AND score >= {RULES.min_score} AS ok, score, files, lines, found, supporting, coalesce(early, CASE WHEN score < {RULES.min_score} THEN 'score ' || score || ' < {RULES.min_score}' END, '') AS reason FROM s""",
        "makefile_name": "SELECT * FROM (VALUES (1, 'ircserv'), (2, 'bot'), (3, '$(TARGET)'), (4, NULL), (5, 'a b')) t(id, name)",
        "locate_dirs": f"WITH {DIRS} SELECT repo, root, count(*) AS files FROM dr GROUP BY repo, root",
        "locate_score": f"WITH {DIRS}, q AS ({_scored('dr', 'root')}) SELECT repo, root, hits, supporting, sources, {_SCORE} FROM q",
        "locate_best": f"""WITH {DIRS}, q AS (SELECT *, {_SCORE} FROM ({_scored('dr', 'root')})), w AS (SELECT *, {_SCORE} FROM ({_scored('l1', "''")})),
            b AS (SELECT repo, root, score, row_number() OVER (PARTITION BY repo ORDER BY score DESC, root) AS r FROM q WHERE score > 0), w1 AS (SELECT repo, score FROM w WHERE score > 0), b1 AS (SELECT repo, root, score FROM b WHERE r = 1)
            SELECT coalesce(b1.repo, w1.repo) AS repo, coalesce(b1.root, '') AS root, coalesce(b1.score, w1.score) AS score FROM b1 FULL JOIN w1 ON w1.repo = b1.repo""",
        "event_discovery": "SELECT repo_name AS full_name, count(*) AS archive_events, strftime(min(created_at), '%Y-%m-%d') AS first_seen, strftime(max(created_at), '%Y-%m-%d') AS pushed_at, string_split(repo_name, '/')[1] AS owner, 0 AS size, 'events' AS found_by FROM github_events WHERE ("
        + " OR ".join(f"contains(lower(repo_name), '{p}')" for p in EVENT_PARTS)
        + ") AND contains(repo_name, '/') GROUP BY repo_name HAVING count(*) >= 2",
        "event_delay": "SELECT logged_at > created_at + INTERVAL 1 DAY AS late, count(*) AS events FROM (SELECT DISTINCT * FROM github_events) GROUP BY 1",
        "month_slices": "SELECT strftime(m, '%Y-%m-%d') || '..' || strftime(last_day(m), '%Y-%m-%d') AS slice FROM (SELECT unnest(generate_series(DATE '2015-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS m)",
        "candidate_keep": "SELECT cand_id, full_name, size FROM candidates WHERE NOT coalesce(fork, false) AND coalesce(size, 0) BETWEEN 40 AND 6000",
        "first_source_wins": "SELECT full_name, cand_id, found_by FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY CASE WHEN batch_no = 0 THEN 0 WHEN found_by = 'gharchive' THEN 1 ELSE 2 END, cand_id) AS r FROM candidates WHERE full_name IS NOT NULL) WHERE r = 1",
        "resume_todo": "SELECT cand_id, full_name FROM candidates WHERE full_name IS NOT NULL AND full_name NOT IN (SELECT name FROM repo WHERE name IS NOT NULL)",
        "requeue_by_reason": "SELECT cand_id, found_by FROM candidates WHERE contains(lower(found_by), 'topic:') OR contains(lower(found_by), 'docker')",
        "owner_expansion": "WITH u AS (SELECT DISTINCT owner FROM candidates WHERE owner IS NOT NULL AND full_name IN (SELECT name FROM repo)) SELECT cand_id, full_name, owner FROM candidates WHERE owner IN (SELECT owner FROM u) AND regexp_matches(regexp_extract(full_name, '[^/]*$'), '(?i)irc|cpp') AND full_name NOT IN (SELECT name FROM repo)",
        "newest_events": "SELECT repo_name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, r AS rank FROM (SELECT repo_name, created_at, row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC NULLS LAST) AS r FROM (SELECT DISTINCT repo_name, created_at FROM github_events WHERE repo_name IS NOT NULL)) WHERE r <= 3",
        "candidate_status": "SELECT batch_no, count(*) AS rows, count(repo) AS indexed, count(*) FILTER (WHERE fork) AS forks, count(*) FILTER (WHERE size = 0) AS unsized FROM candidates GROUP BY batch_no",
    }
