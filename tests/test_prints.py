import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codekin.operators.prints import blocks, density, file_tokens, kgrams, winnow, with_tokens
from codekin.scratch import materialise


def naive(tokens, k, w):
    """By the definition: the set of the leftmost least grams of all windows, in order."""
    grams = [(int(hashlib.md5(" ".join(tokens[i : i + k]).encode()).hexdigest()[:15], 16), i) for i in range(len(tokens) - k + 1)]
    windows = [grams[i : i + w] for i in range(len(grams) - w + 1)] or ([grams] if grams else [])
    return sorted({min(x) for x in windows}, key=lambda g: g[1])


def stream(texts):
    return [t for p in sorted(texts) for t in texts[p].split()]


def frame(spark, repos):
    return spark.createDataFrame([(r, p, t) for r, ts in repos.items() for p, t in ts.items()], "repo string, relpath string, text string")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("( ) ; { } = + - if for int".split()), max_size=40), min_size=1, max_size=4), st.integers(1, 6), st.integers(1, 5))
def test_winnow_against_naive(spark, files, k, w):
    repos = {"r": {f"{i}.cpp": " ".join(ts) for i, ts in enumerate(files)}}
    want = naive(stream(repos["r"]), k, w)
    got = sorted((r.pos, r.hash) for r in winnow(frame(spark, repos), k, w, block=16).collect())
    assert got == sorted((p, h) for h, p in want)


def test_short_streams(spark):
    repos = {"none": {"a.cpp": "( ) ;"}, "one": {"a.cpp": "( ) ; {"}, "few": {"a.cpp": "( ) ;", "b.cpp": "{ } = +"}}
    got = winnow(frame(spark, repos), 4, 8).groupBy("repo").count().collect()
    assert {r["repo"]: r["count"] for r in got} == {"one": 1, "few": 1}


def test_neighbours_cross_blocks(spark):
    rng = random.Random(2)
    words = [rng.choice("( ) ; { } = + -".split()) for _ in range(50)]
    rows = frame(spark, {"r": {"a.cpp": " ".join(words[:20]), "b.cpp": " ".join(words[20:])}})
    for block in (4, 7, 64):
        got = {r.pos: (r.prev, r.hash, r.next) for r in kgrams(rows, 3, block=block, neighbours=True).collect()}
        h = [got[i][1] for i in range(48)]
        assert len(got) == 48 and got == {i: (h[i - 1] if i else -1, h[i], h[i + 1] if i < 47 else -2) for i in range(48)}


def test_grams_cross_files_and_nulls(spark):
    rows = [("r", "a.cpp", "( )"), ("r", "b.cpp", "; {"), ("r", "b.cpp", "; {"), ("r", "c.cpp", None), (None, "a.cpp", "("), ("e", "a.cpp", "")]
    df = spark.createDataFrame(rows, "repo string, relpath string, text string")
    assert kgrams(df, 3, block=2).count() == 2
    assert density(df, 3, 2).first().asDict() == {"tokens": 4, "grams": 2, "prints": 1, "prints_per_gram": 0.5}


def test_shared_run_shares_a_print(spark):
    k, w = 5, 4
    run = "( ) ; { } = + -".split()
    repos = {"a": {"x.cpp": " ".join(["if"] * 7 + run)}, "b": {"x.cpp": " ".join(run + ["for"] * 9)}}
    assert len(run) == k + w - 1
    sets = {}
    for r in winnow(frame(spark, repos), k, w).collect():
        sets.setdefault(r.repo, set()).add(r.hash)
    assert sets["a"] & sets["b"]


def test_token_arrays_are_not_broadcast(spark):
    rows = frame(spark, {"r": {"a.cpp": "( ) ; " * 2000}})
    tokens = materialise(file_tokens(rows), "tokens")
    assert "Broadcast" not in blocks(tokens, 3)._jdf.queryExecution().sparkPlan().toString()


def test_with_tokens_agrees_with_the_tokens(spark):
    texts = ["", " \t\n\u00a0", "// only a remark", "/* a\n */ // b", "/* open", "x", "\u00e9", "\u00e9a", "\u0663", "\u00bd", "\u0301", "\u2028", '"', "'", "\\", "# c++", "_", "\x00", "\U0001f600", "$", "#\n \n", "\\#"]
    rows = [(f"{p}{i}", f"{p}", t) for p in ("a.cpp", "Dockerfile", "run.sh", "a.txt") for i, t in enumerate(texts)]
    rows += [("n", "a.cpp", None), (None, "a.cpp", "x"), ("p", None, "x"), ("two", "a.cpp", "x"), ("two", "a.cpp", "//~"), ("two", "a.cpp", "// ~")]
    df = spark.createDataFrame(rows, "repo string, relpath string, text string")
    want = {r.repo for r in file_tokens(df).where("size(toks) > 0").collect()}
    got = [r.repo for r in with_tokens(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
