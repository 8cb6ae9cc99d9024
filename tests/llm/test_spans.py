import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codekin.llm import spans

SCHEMA = "hash long, repo long, file string, line int, pos int"


def naive(records, window):
    """records: {(repo, file): [(pos, hash), ...]}."""
    where = {}
    for r, rows in records.items():
        for i in range(len(rows) - window + 1):
            where.setdefault(tuple(h for _, h in rows[i : i + window]), set()).add(r)
    out = []
    for r, rows in records.items():
        covered = set()
        for i in range(len(rows) - window + 1):
            if len(where[tuple(h for _, h in rows[i : i + window])]) > 1:
                covered |= set(range(i, i + window))
        run = []
        for i in range(len(rows) + 1):
            if i in covered:
                run.append(i)
            elif run:
                out.append((*r, rows[run[0]][0], rows[run[-1]][0]))
                run = []
    return sorted(out)


def found(spark, records, window, extra=()):
    rows = [(h, r, f, None if p % 3 else p, p) for (r, f), rs in records.items() for p, h in rs]
    df = spark.createDataFrame([*rows, *extra], SCHEMA)
    return sorted(tuple(r) for r in spans.shared_spans(df, window).collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=5), st.integers(2, 5))
def test_against_naive(spark, files, window):
    records = {(i % 2, f"f{i}"): [(3 * p, h) for p, h in enumerate(f)] for i, f in enumerate(files)}
    assert found(spark, records, window) == naive(records, window)


def test_blocks_and_chunks_join(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_BITS", 4)
    monkeypatch.setattr(spans, "CHUNK_ROWS", 7)
    rng = random.Random(2)
    shared = [rng.randint(0, 9) for _ in range(90)]
    records = {(1, "a"): list(enumerate(shared)), (2, "a"): [(2 * i, h) for i, h in enumerate(shared[5:70] + shared[:9])], (3, "b"): [(40 * i, h) for i, h in enumerate(shared[20:60])], (4, "b"): [(i, 7) for i in range(100)], (5, "c"): [(i, 7) for i in range(20)]}
    for window in (4, 16):
        assert found(spark, records, window) == naive(records, window)


def test_nulls_repeats_and_adjacent_windows(spark):
    a = [(i, 100 + i) for i in range(8)]
    records = {(1, "a"): a, (2, "b"): a[:4], (3, "c"): a[4:], (4, "short"): a[:3]}
    extra = [(None, 1, "a", 1, 99), (5, None, "a", 1, 1), (5, 1, None, 1, 1), (5, 1, "a", 1, None), (100, 1, "a", None, 0), (100, 1, "a", None, 0)]
    # Two windows from different records touch and become one case.
    assert found(spark, records, 4, extra) == [(1, "a", 0, 7), (2, "b", 0, 3), (3, "c", 4, 7)]
    assert found(spark, {}, 4) == []


def test_one_record_is_no_case(spark):
    assert found(spark, {(1, "a"): [(i, i % 4) for i in range(60)]}, 4) == []


def test_report(spark):
    a = [(i, 100 + i) for i in range(8)]
    rows = [(h, r, "a", None, p, 5) for r in (1, 2) for p, h in a] + [(7, 1, "b", None, 9, 5)]
    prints = spark.createDataFrame(rows, SCHEMA + ", spans int")
    repos = spark.createDataFrame([(1, 36), (2, None)], "id long, tokens int")
    got = {(r.repo, r.file): r for r in spans.shared_report(prints, repos, 4).collect()}
    assert (got[1, "a"].spans, got[1, "a"].shared_tokens, got[1, "a"].file_share, got[1, "a"].repo_tokens) == (1, 8, 1.0, 36)
    assert (got[1, "b"].spans, got[1, "b"].file_share) == (0, 0.0) and got[2, "a"].repo_share == 1.0


@pytest.mark.parametrize("window", [1, 5, 40])
def test_rolling_hash_is_the_polynomial(window):
    v = np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64)
    base = spans.BASE_A
    want = [sum(int(x) * pow(base, window - 1 - k, 1 << 64) for k, x in enumerate(v[i : i + window])) % (1 << 64) for i in range(len(v) - window + 1)]
    assert spans.rolling_hashes(v, window, base).tolist() == want
