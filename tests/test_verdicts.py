import random

import pytest

from codekin import queries
from codekin.operators import index, prints, runs
from codekin.operators.closest import closest


def components(nodes, edges):
    of = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    return of


@pytest.mark.parametrize("block_rows", [10**6, 150])
@pytest.mark.parametrize("cap", [200, 2])
def test_closest_against_all_pairs(spark, block_rows, cap):
    rng = random.Random(3)
    d = {r: set(rng.sample(range(90), rng.randint(1, 25))) for r in range(1, 60)} | {99: {-1}, 100: {5, -2}}
    d[61] = set(d[7])
    b = index.buckets(spark.createDataFrame([(r, h) for r, hs in d.items() for h in hs], "repo long, hash long"), cap)
    score = {(x, y): len(d[x] & d[y]) / min(len(d[x]), len(d[y])) for x in d for y in d if x != y and d[x] & d[y]}
    best, links = closest(b, 4, 0.6, block_rows)
    want = {x: sorted((-s, y) for (p, y), s in score.items() if p == x)[:4] for x in d}
    got = {x: sorted((-r.containment, r.b) for r in rows) for x, rows in ((x, [r for r in best.collect() if r.a == x]) for x in d)}
    assert got == want
    assert all(r.shared == len(d[r.a] & d[r.b]) for r in best.collect())
    assert components(d, [(r.a, r.b) for r in links.collect()]) == components(d, [p for p, s in score.items() if s >= 0.6])


def test_longest_substring(spark):
    rng = random.Random(4)
    for _ in range(600):
        a, b = ("".join(rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(0, 40))) for _ in range(2))
        least = rng.randint(2, 6)
        longest = max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
        assert runs.longest_substring(a, b, least) == (longest if longest >= least else 0)


@pytest.mark.parametrize("long", [10**6, 60, 0])
def test_longest_common_agrees_with_maximal_runs(spark, long):
    rng = random.Random(6)
    words = ["x", "+", "(", ")", "if", "for", "return", "{", "}", ";"]
    part = [" ".join(rng.choices(words, k=n)) for n in (15, 24, 40, 90)]
    rows = [(str(i), f"{k}.cpp", " ".join(rng.choices(part * 3 + words, k=rng.randint(0, 7)))) for i in range(8) for k in range(2)] + [("9", "a.cpp", None)]
    sources = spark.createDataFrame(rows, "repo string, relpath string, text string")
    pairs = spark.createDataFrame([(str(a), str(b)) for a in range(10) for b in range(10) if a != b], "a string, b string")
    want = runs.longest_runs(pairs, runs.maximal_runs(pairs, prints.kgrams(sources, runs.K, neighbours=True))).collect()
    assert {tuple(r) for r in runs.longest_common(pairs, sources, long=long).collect()} == {tuple(r) for r in want}
    assert len({r.longest for r in want}) > 3


def test_every_repository_is_judged(spark, tmp_path):
    """Not only those whose id 50 divides."""
    text = "int f(int a) { for (int i = 0; i < a; i++) { if (i > 3 && a < 9) { return i + a * 2; } } return a - 1; }\n"
    ids = range(1, 42)
    hashes = {r: [1000 * r + i for i in range(9)] for r in ids}
    hashes[3] = hashes[2][:8] + [3]  # a copy, and others that share one hash
    for r in (5, 6, 7):
        hashes[r] = [*hashes[r][:8], 77]
    spark.createDataFrame([(h, r, "a.cpp", i, i) for r, hs in hashes.items() for i, h in enumerate(hs)], "hash long, repo long, file string, line int, pos int").write.parquet(f"{tmp_path}/print.parquet")
    spark.createDataFrame([(r, f"o{r}/p", "Me" if r in (5, 6) else f"o{r}") for r in ids], "id long, name string, owner string").write.parquet(f"{tmp_path}/repo.parquet")
    spark.createDataFrame([(f"o{r}/p", "a.cpp", text * 3 if r < 4 else "int x;") for r in ids], "repo string, relpath string, text string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = {(r.sub, r["rank"]): (r.repo, r.containment, r.verdict) for r in queries.check_verdicts(spark, str(tmp_path)).collect()}
    assert {k: (x, round(c, 9)) for k, (x, c, _) in got.items()} == {(2, 1): (3, round(8 / 9, 9)), (3, 1): (2, round(8 / 9, 9))} | {(a, i): (b, round(1 / 9, 9)) for a, bs in ((5, (6, 7)), (6, (5, 7)), (7, (5, 6))) for i, b in enumerate(bs, 1)}
    assert (got[2, 1][2], got[5, 1][2], got[6, 1][2]) == ("HIGH", "SELF", "SELF")
