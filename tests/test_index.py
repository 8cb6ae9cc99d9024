import random

import pytest
from pyspark.sql import functions as F

from codekin.operators import calibrate, check, clusters, hotkeys, index, runs


def sets_of(spark, d):
    return spark.createDataFrame([(r, h) for r, hs in d.items() for h in hs], "repo long, hash long")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    d = {r: set(rng.sample(range(400), rng.randint(3, 60))) | {1000 + r % 3} for r in range(40)}
    d[40] = set(d[3])
    return d


def pairs_of(d, cap):
    df = {}
    for hs in d.values():
        for h in hs:
            df[h] = df.get(h, 0) + 1
    out = {}
    for a in d:
        for b in d:
            if a < b and any(2 <= df[h] <= cap for h in d[a] & d[b]):
                out[a, b] = len(d[a] & d[b]) / min(len(d[a]), len(d[b]))
    return out


@pytest.mark.parametrize("cap", [200, 6])
@pytest.mark.parametrize("least", [0.0, 0.15])
def test_containment_counts_full_sets(spark, corpus, cap, least):
    got = {(r.a, r.b): r.containment for r in index.pair_containment(index.buckets(sets_of(spark, corpus), cap), least).collect()}
    assert got == {k: v for k, v in pairs_of(corpus, cap).items() if v >= least}


@pytest.mark.parametrize("least", [0.0, 0.15, 0.5])
def test_whole_search_knows_no_cap(spark, corpus, least):
    d = corpus | {100 + i: set(range(2000, 2010)) for i in range(9)} | {200: set(range(2000, 2004)) | {1}, 201: set(range(2000, 2010)) | {3001}, 202: set(range(2000, 2010)) | {3002}}
    got = index.similarity_edges(sets_of(spark, d), least, 6, whole=True).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): r.containment for r in got} == {k: v for k, v in pairs_of(d, 10**9).items() if v >= least}


def test_boilerplate_counts_print_less_repositories(spark):
    prints = spark.createDataFrame([(7, 1, "a", 1, 1), (7, 1, "a", 1, 1), (8, 2, "a", None, 1), (None, 2, "a", 1, 1)], "hash long, repo long, file string, line int, pos int")
    for n, want in ((4, {7, 8}), (5, set())):
        repos = spark.range(n).toDF("id")
        assert {r.hash for r in index.boilerplate(prints, repos).collect()} == want


def test_clusters(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in ((1, 5), (2, 9), (3, 9), (4, 1), (9, 2))], "repo long, n long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9)], "a long, b long")
    got = {r.repo: (r.cluster, r.members, r.representative) for r in clusters.representatives(sizes, edges).collect()}
    assert got == {1: (1, 3, 0), 2: (1, 3, 1), 3: (1, 3, 0), 4: (4, 1, 1), 9: (9, 1, 1)}


def test_ranked_values_use_floor_ranks(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(1, 101)], "v double")
    r = calibrate.ranked_values(df, "v", {"p95": 0.95, "p50": 0.5, "top": 1.0}).first()
    assert (r.p95, r.p50, r.top) == (0.96, 0.51, 1.0)
    assert calibrate.ranked_values(df.limit(0), "v", {"p95": 0.95}).first().p95 == 0.0


def test_null_stats_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, shared long, containment double")
    assert calibrate.baseline_stats(none).first().asDict() == {"pairs": 0, "mean": 0.0, "stdev": 0.0, "max": 0.0, "p95": 0.0}
    best = calibrate.top_match(none, spark.createDataFrame([(1,)], "repo long"))
    assert [tuple(r) for r in best.collect()] == [(1, 0.0)]
    longest = spark.createDataFrame([], "a long, b long, longest long")
    assert calibrate.run_null_stats(longest, 10).first().threshold == 250


def test_run_threshold_bounds(spark):
    longest = spark.createDataFrame([(1, i, i * 10) for i in range(100)], "a long, b long, longest long")
    r = calibrate.run_null_stats(longest, 1000).first()
    assert (r.median, r.p99, r.threshold) == (500.0, 990.0, 1188)


BANDS = [
    (dict(containment=0.30, p99=0.1), "HIGH"),
    (dict(containment=0.2999, p99=0.1), "MEDIUM"),
    (dict(containment=0.18, p99=0.12), "MEDIUM"),
    (dict(containment=0.1799, p99=0.12), "LOW"),
    (dict(containment=0.1199, p99=0.12), "NORMAL"),
    (dict(containment=0.0, p99=0.5, longest=250), "LOW"),
    (dict(containment=0.0, p99=0.5, longest=249), "NORMAL"),
    (dict(containment=0.0, p99=0.5, ast_frac=0.4, ast_n=8), "HIGH"),
    (dict(containment=0.0, p99=0.5, ast_frac=0.4, ast_n=7), "NORMAL"),
    (dict(containment=0.0, p99=0.5, sig_frac=0.3, sig_n=8), "MEDIUM"),
    (dict(containment=0.9, p99=0.5, self_match=True), "SELF"),
]


@pytest.mark.parametrize(("row", "want"), BANDS)
def test_bands(spark, row, want):
    df = spark.createDataFrame([row])
    assert df.select(check.band(df.columns).alias("v")).first().v == want


def test_scores_and_gate(spark):
    sets = sets_of(spark, {1: {1, 2, 3, 4}, 2: {1, 2}, 3: {9}})
    subs = spark.createDataFrame([(100, h) for h in (1, 2, 3)], "sub long, hash long")
    scored = check.scores(subs, sets, index.set_sizes(sets))
    assert {r.repo: (r.shared, r.containment) for r in scored.collect()} == {1: (3, 1.0), 2: (2, 1.0)}
    top = check.top_matches(scored).withColumn("verdict", F.lit("NORMAL"))
    assert [(r.repo, r["rank"]) for r in top.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    null = spark.createDataFrame([(0.5, 0.0, 0.9)], "mean double, stdev double, p99 double")
    assert check.with_z(scored, null).first().z == 0.5 / 1e-9
    assert check.evidence_gate(top).count() == 2


def naive_runs(a, b, k, least):
    out = []
    for i in range(len(a)):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= max(k, least):
                out.append((i, j, n))
    return sorted(out)


def test_maximal_runs(spark):
    rng = random.Random(3)
    a = [rng.choice("ab") for _ in range(60)] + ["x"] * 30
    b = ["x"] * 25 + a[10:45] + [rng.choice("ab") for _ in range(30)]
    rows = [(r, i, hash(tuple(t[i : i + 4])) % (1 << 40)) for r, t in ((1, a), (2, b)) for i in range(len(t) - 3)]
    grams = spark.createDataFrame(rows, "repo long, pos long, hash long")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    found = runs.maximal_runs(pairs, grams, 8, 4)
    assert sorted((r.i, r.j, r.tokens) for r in found.collect()) == naive_runs(a, b, 4, 8)
    assert {(r.a, r.b): r.longest for r in runs.longest_runs(pairs, found).collect()} == {(1, 2): max(n for *_, n in naive_runs(a, b, 4, 8)), (1, 3): 0}
    # What is left to plan reads written starts and ends; grams and their joins don't stand in it.
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys(spark):
    rows = [(1 if i % 3 == 0 else i, i % 7, f"f{i % 5}") for i in range(3000)] + [(None, 1, "x")] * 5
    df = spark.createDataFrame(rows, "key long, v long, f string")
    assert [(r.key, r.n) for r in hotkeys.heavy_keys(df, "key", 0.01).collect()] == [(1, 1001)]
    assert sorted((r.key, r.n) for r in hotkeys.heavy_keys(df, "key", 1e-7).where("n > 1 or key < 3").collect()) == [(1, 1001), (2, 1)]
    assert hotkeys.heavy_keys(df.limit(0), "key").count() == 0
    profile = {r.key: r for r in hotkeys.key_profile(df, "key", {"n_f": ["f"]}).collect()}
    assert profile[1].n_f == 5 and None not in profile


def test_key_quantiles(spark):
    rng = random.Random(1)
    vals = {1: [rng.randint(-(10**6), 10**6) for _ in range(500)], 2: [7], 3: [5, 5, 5, 9]}
    df = spark.createDataFrame([(k, v) for k, vs in vals.items() for v in vs] + [(1, None), (None, 3)], "key long, v long")
    got = {(r.key, r.q): r.v for r in hotkeys.key_quantiles(df, "key", "v", [0.0, 0.5, 0.99, 1.0]).collect()}
    assert got == {(k, q): sorted(vs)[min(len(vs) - 1, int(q * len(vs)))] for k, vs in vals.items() for q in (0.0, 0.5, 0.99, 1.0)}
    salted = {(r.key, r.q): r.v for r in hotkeys.key_quantiles(df, "key", "v", [0.0, 0.5, 0.99, 1.0], hot=100).collect()}
    assert salted == got
    assert hotkeys.key_quantiles(df.limit(0), "key", "v", [0.5]).count() == 0
