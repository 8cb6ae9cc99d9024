import random

import pytest

from codekin.llm import groups, history, setjoin, termstats


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    d = {}
    for r in range(n):
        own = {rng.randint(0, 10**9) for _ in range(rng.randint(1, 25))}
        common = set(rng.sample(range(30), rng.randint(0, 14)))
        d[r] = own | common
        if r and rng.random() < 0.4:
            other = sorted(d[rng.randrange(r)])
            d[r] |= set(rng.sample(other, rng.randint(1, len(other))))
    d[n] = set(d[3])
    d[n + 1] = set(d[3])
    return d


def frame(spark, d):
    return spark.createDataFrame([(r, h) for r, hs in d.items() for h in hs], "id long, tok long")


def matching(d):
    return sorted((a, b) for a in d for b in d if a < b and d[a] and d[b] and 2 * len(d[a] & d[b]) >= min(len(d[a]), len(d[b])))


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    d = corpus(seed)
    join = setjoin.similar_sets(frame(spark, d))
    assert sorted(tuple(r) for r in setjoin.expand_pairs(join).collect()) == matching(d)
    links = {r.id: (r.members, r.links) for r in setjoin.link_counts(join).collect()}
    assert {k: v[1] for k, v in links.items()} == {k: sum(k in p for p in matching(d)) for k in d}
    assert links[3][0] == 3


def test_other_share(spark):
    d = corpus(4, 30)
    want = sorted((a, b) for a in d for b in d if a < b and 5 * len(d[a] & d[b]) >= 4 * min(len(d[a]), len(d[b])))
    assert sorted(tuple(r) for r in setjoin.expand_pairs(setjoin.similar_sets(frame(spark, d), 0.8)).collect()) == want


def test_sets_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, 5, 0), (1, 5, 1), (1, None, 0), (None, 5, 0), (2, 5, 0), (2, 6, 0), (3, 6, 9)]
    df = spark.createDataFrame(rows, "repo long, hash long, tok int")
    boiler = spark.createDataFrame([(6,), (None,)], "hash long")
    join = setjoin.repository_pairs(df, boiler)
    assert sorted(tuple(r) for r in setjoin.expand_pairs(join).collect()) == [(1, 2)]
    assert setjoin.expand_pairs(setjoin.repository_pairs(df.limit(0), boiler)).count() == 0


@pytest.mark.parametrize("per_pivot", [2, 64])
def test_history_against_brute_force(spark, per_pivot, monkeypatch, tmp_path):
    monkeypatch.setattr(history, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(history, "COMMON_LEAST", 5)
    monkeypatch.setattr(history, "COMMON_SHARE", 0.0)
    d = corpus(7, 40)
    batch = {r: r // 14 for r in d}
    again = [(5, 2), (20, 2), (3, 1)]  # repositories that come in a later batch once more
    rows = spark.createDataFrame([(batch[r], r) for r in d] + [(k, r) for r, k in again] + [(None, 1), (1, None)], "batch_no int, repo long")
    both = {(a, b) for a, b in matching(d)} | {(b, a) for a, b in matching(d)}
    last = {r: max([batch[r]] + [k for x, k in again if x == r]) for r in d}
    whole = frame(spark, d)
    got = [(r.probe, r.id) for r in history.match_batches(rows, lambda ids: whole.join(ids, "id", "left_semi"), str(tmp_path / "a")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in both if any(k >= 1 and batch[b] <= k for k in [batch[a]] + [k for x, k in again if x == a])}
    assert last[5] == 2
    none = history.match_batches(rows.limit(0), lambda ids: whole.join(ids, "id", "left_semi"), str(tmp_path / "none"))
    assert none.count() == 0


def test_reads_only_what_a_batch_meets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "PER_GROUP", 1)
    monkeypatch.setattr(history, "PER_PIVOT", 4)
    sets = lambda k, n=12: frame(spark, {100 * k + i: set(range(10000 * k + 20 * i, 10000 * k + 20 * i + 10)) for i in range(n)})
    new = {901: set(range(10000, 10009)) | {1}, 902: {7, 8, 9}}  # close to the first record of batch 1
    read = []
    for extra in (0, 3):
        index = history.HistoryIndex(spark, str(tmp_path / f"i{extra}"), 4)
        for k in [1, *range(2, 2 + extra)]:
            index.accept(sets(k), k)
        index.accept(frame(spark, new), 9)
        assert [(r.probe, r.id) for r in index.match(frame(spark, new).select("id"), 9).collect()] == [(901, 100)]
        read.append(index.read_parts)
        index.close()
    assert read[0] == read[1] and len(read[0]) == 2


def test_first_matches(spark):
    rows = [
        (1, 0, "Ann/x", "https://h.example/Ann/x.git", 1), (2, 0, "ann/Y", None, 2), (3, 1, " ANN/X.git/", None, None), (4, 1, None, "git@h.example:ann/x", None), (5, 1, "b/q", "ssh://git@www.h.example:443/ann/x.git/", 3),
        (6, 1, "ann/x_2", "https://h.example/ann/x-2", None), (7, 2, "B/Q", None, None), (8, 2, "c/c", None, 4), (9, 2, None, None, None), (10, 2, "", "", None), (11, 2, "", "", None), (12, 0, "d/d", None, 5), (13, None, "d/d", None, None), (14, 2, "d/d", "HTTP://h.example/z/z", None),
    ]
    c = spark.createDataFrame([(*r, "k") for r in rows], "cand_id long, batch_no int, full_name string, clone_url string, repo long, key string")
    prints = spark.createDataFrame([(h, r) for r, hs in {1: range(10), 2: range(50, 60), 3: range(100, 110), 4: range(5, 11)}.items() for h in hs], "hash long, repo long")
    boiler = spark.createDataFrame([], "hash long")
    got = {r.cand_id: r.first_id for r in history.first_matches(c, prints, boiler).collect()}
    assert got == {3: 1, 4: 1, 5: 1, 7: 5, 8: 1, 14: 12}
    assert history.first_matches(c.limit(0), prints.limit(0), boiler).count() == 0


def components(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(500, k) for k in range(501, 540)]
    dirty = pairs + [(b, a) for a, b in pairs[:20]] + [(1000, 1000), (None, 3), (4, None)]
    got = {r.id: r.group_id for r in groups.connected_groups(spark.createDataFrame(dirty, "a long, b long")).collect()}
    assert got == components([p for p in pairs if p[0] != p[1]])


def test_group_links(spark):
    edges = spark.createDataFrame([(1, 2, 0.15, 1), (2, 3, 0.1499, 1), (4, 3, float("nan"), 1), (3, 9, None, 1), (5, 77, 0.9, 1), (6, 5, 0.5, 1), (5, 6, 0.1, 1)], "src long, dst long, containment double, id int")
    repos = spark.createDataFrame([(i, None) for i in range(1, 10)] + [(None, 3)], "id long, cluster int")
    assert sorted(tuple(r) for r in groups.repository_groups(edges, repos).collect()) == [(1, 1), (2, 1), (5, 5), (6, 5)]
    every = {r.id: (r.group_id, r.members) for r in groups.assign_all(edges, repos).collect()}
    assert every[3] == (3, 1) and every[6] == (5, 2) and len(every) == 9
    assert groups.repository_groups(edges.limit(0), repos).count() == 0


def test_terms_by_deltas(spark, tmp_path):
    schema = "hash long, repo long, pos int, term string"
    before = [(1, 1, 1, "z"), (1, 1, 1, "z"), (1, 1, 2, "z"), (2, 1, 3, "z"), (2, 2, 1, "z"), (None, 2, 1, "z"), (3, None, 1, "z"), (9, 4, 1, "z")]
    after = [(1, 2, 1, "z"), (1, 2, 5, "z"), (2, 2, 1, "z"), (7, 3, 1, "z")]  # repository 2 changed, 3 came, 4 went
    terms = lambda rows: termstats.record_terms(spark.createDataFrame(rows, schema), "hash", "repo", "term", ["pos"])
    table = termstats.TermTable(spark, str(tmp_path / "terms"))
    table.build(terms(before))
    assert {tuple(r) for r in table.counts().collect()} == {(1, 2, 1), (2, 2, 2), (9, 1, 1)}
    table.update(terms([r for r in before if r[1] in (2, 4)]), terms(after))
    assert {tuple(r) for r in table.counts().collect()} == {(1, 4, 2), (2, 2, 2), (7, 1, 1)}
    table.update(terms(before[:1]), terms(before[:1]))
    table.update(None, terms([]))
    assert {tuple(r) for r in table.counts().collect()} == {(1, 4, 2), (2, 2, 2), (7, 1, 1)}


def test_small_deltas_rewrite_nothing(spark, tmp_path):
    terms = lambda rows: spark.createDataFrame(rows, "term long, record long, k long")
    table = termstats.TermTable(spark, str(tmp_path / "t"), parts=8)
    table.build(terms([(t, 1, 2) for t in range(400)]))
    before = {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    table.update(None, terms([(5, 2, 3), (1000, 2, 1)]))
    after = {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    assert before < after and len({p.split("part=")[1].split("/")[0] for p in after - before}) <= 2
    table.update(terms([(t, 1, 2) for t in range(390)]), None)  # most terms go, which is worth a merge
    assert {tuple(r) for r in table.counts().collect()} == {(5, 3, 1), (1000, 1, 1)} | {(t, 2, 1) for t in range(390, 400)}
    assert table.merge(0.5) == [] and table.read().where("not merged").count() == 0


def test_batches_equal_a_recount(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(0, 40), rng.randint(1, 12), rng.randint(1, 3)) for _ in range(300)]
    rows = list({(t, r): (t, r, k) for t, r, k in rows}.values())
    terms = spark.createDataFrame(rows, "term long, record long, k long")
    batches = spark.createDataFrame([(r, b) for r, b in ((1, 0), (2, 0), (3, 1), (3, 4), (4, 2), (5, 4), (None, 1), (6, None), (99, 3))], "record long, batch int")
    got = {tuple(r) for r in termstats.by_batches(terms, batches, termstats.TermTable(spark, str(tmp_path / "b"), 4)).counts().collect()}
    assert got == {(t, sum(k for x, _, k in rows if x == t), sum(x == t for x, _, _ in rows)) for t in {x for x, _, _ in rows}}
    assert termstats.by_batches(terms.limit(0), batches.limit(0), termstats.TermTable(spark, str(tmp_path / "e"), 4)).counts().count() == 0


def test_marks(spark):
    state = spark.createDataFrame([(1, 9, 5), (2, 9, 4), (3, 2, 1)], "term long, n_rows long, n_records long")
    total = spark.createDataFrame([(20,)], "total long")
    listed = spark.createDataFrame([(1,), (3,), (8,), (8,), (None,)], "hash long")
    assert sorted(tuple(r) for r in termstats.mark_terms(state, listed, total).collect()) == [(1, "common"), (3, "rare"), (8, "rare")]
