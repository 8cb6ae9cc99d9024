import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codekin.llm import handwritten, leakage, packing, readlevel
from codekin.llm.pages import alike, joined, ordered_lines

PAGE = "doc_id long, text string, lang string, source string, line_boxes array<struct<x int, y int, w int, h int, conf int>>, key string"
ITEM = (
    "The old harbour master counted every barrel on the quay before the morning tide came in, and he wrote the number "
    "in a large green book which nobody else in the town of Wexmouth was ever allowed to open or to read."
)


def page(doc, text, boxes=None, lang="en"):
    return (doc, text, lang, None, boxes, "k")


def test_reading_order():
    lines = ["left one", "right one", "left two", "right two"]
    xs, ys = [60, 430, 58, 428], [80, 82, 100, 101]
    assert ordered_lines("\n".join(lines), xs, ys) == ["left one", "left two", "right one", "right two"]
    assert ordered_lines("a\nb", [1], [1]) == ["a", "b"]
    assert ordered_lines(None, None, None) == [""]
    assert ordered_lines("a\nb\nc", [1, None, 500], [1, 2, 3]) == ["a", "b", "c"]
    assert joined(["admini-", "stration of"]) == "administration of"
    assert alike("The Harbour") == alike("tlie hurb0ur")


def mangle(words, rng):
    out = []
    for i, w in enumerate(words):
        if i % 7 == 3:
            w = w.replace("e", "c", 1).replace("m", "rn", 1)
        out.append(w)
    lines, row = [], ""
    for w in out:
        if len(row) + len(w) > 30:
            cut = len(w) // 2
            lines.append(f"{row} {w[:cut]}-" if cut > 1 else row)
            row = w[cut:] if cut > 1 else w
        else:
            row = f"{row}{'' if rng.random() < 0.1 else ' '}{w}".strip()
    return [*lines, row]


def test_leaks(spark):
    rng = random.Random(1)
    words = ITEM.split()
    other = "When the rain had stopped the two brothers walked over the wet hills to look for their lost grey mare.".split()
    whole = other + words + other
    part = other + words[8:26] + other
    short = other + words[8:18] + other
    advert = mangle(other + words, rng)
    advert.insert(len(advert) - 3, "FOR SALE, a small boat. Apply Hay.")
    columns = mangle(words + other + words[:4], rng)
    half = (len(columns) + 1) // 2
    order = [x for i in range(half) for x in ((0, i), (1, i)) if x[0] * half + x[1] < len(columns)]
    boxes = [(60 + 400 * c, 80 + 20 * i, 300, 18, None) for c, i in order]
    pages = [page(1, "\n".join(mangle(whole, rng))), page(2, "\n".join(mangle(part, rng))), page(3, "\n".join(mangle(short, rng))), page(4, "\n".join(advert)), page(5, "\n".join(columns[c * half + i] for c, i in order), boxes), page(6, None), page(7, ""), page(None, ITEM), page(8, " ".join(other)), page(1, "\n".join(whole))]
    items = [(10, "s", f"{ITEM}\nQuestion: what is told of Wexmouth?"), (11, "s", f"{ITEM} Q. Which place is meant, Wexmouth or another?"), (12, "s", None), (None, "s", ITEM), (13, "s", ""), (14, "s", "Two words. Answer in one line: why?")]
    got = leakage.leaks(spark.createDataFrame(pages, PAGE), spark.createDataFrame(items, "item_id long, suite string, text string"))
    assert {(r.item_id, r.doc_id) for r in got.collect()} == {(i, p) for i in (10, 11) for p in (1, 2, 4, 5)}
    kept = leakage.without_leaks(spark.createDataFrame(pages, PAGE), got)
    assert {r.doc_id for r in kept.collect()} == {3, 6, 7, 8, None}
    none = spark.createDataFrame([], "item_id long, suite string, text string")
    assert leakage.leaks(spark.createDataFrame(pages, PAGE), none).count() == 0
    assert leakage.leaks(spark.createDataFrame([], PAGE), spark.createDataFrame(items, "item_id long, suite string, text string")).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([page(i, ITEM) for i in range(3)], PAGE)
    items = spark.createDataFrame([(i, ITEM) for i in range(5)], "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_GRAMS", 300)
    assert leakage.leaks(pages, items).count() == 15


def test_packing_against_bounds():
    rng = np.random.default_rng(1)
    sizes = np.minimum(400, rng.lognormal(4, 0.8, 3000).astype(int) + 1)
    where = packing.pack_group(sizes, 400)
    load = np.bincount(where, weights=sizes)
    assert load.max() <= 400 and load.min() > 0
    assert len(load) <= 1.01 * np.ceil(sizes.sum() / 400) + 1
    assert packing.sum_of_squares(np.array([400, 1, 399, 400]), 400).tolist() in ([0, 1, 1, 2],)


def test_pack_round_trip(spark):
    rows = [(1, 5), (1, 5), (2, 25), (3, 0), (4, 10), (None, 4), (5, 3), (6, 30), (7, None)]
    packed = packing.pack(spark.createDataFrame(rows, "id long, n int"), 10, 20).collect()
    total = {}
    for r in packed:
        total[r.container] = total.get(r.container, 0) + r.n
    assert max(total.values()) <= 10
    pieces = {}
    for r in packed:
        pieces.setdefault((r.id, r.copy), []).append((r.start, r.n))
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {(1, 1): 5, (1, 2): 5, (2, 1): 25, (4, 1): 10, (5, 1): 3, (6, 1): 30}
    for v in pieces.values():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
    assert packing.pack(spark.createDataFrame([], "id long, n int")).count() == 0
    assert packing.fill(packing.pack(spark.createDataFrame([], "id long, n int"))).first().containers == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    n = {r.id: r.n for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1
    order = packing.container_order(packing.packed_pages(df)).collect()
    assert {(r.id, r.offset) for r in order} == {(1, 0), (4, 2)}


EASY = "The cat sat on a mat. A dog ran to the cat. He had a red hat and she was with him. "
HARD = "Notwithstanding the considerable jurisdiction, which the constituency of the municipality had acknowledged, the administration repudiated every expenditure of the legislature; nor was the philanthropy of the commemoration contemplated. "


def test_running_sentences():
    lines = "HEADLINE OF ALL\nThe old man went to\nSALE OF CART, Monday.\nthe town. He was\nWANTED, a boy. Apply\nto Mr. Hay, Exe.\nglad.\nNo. 12 Hay 33\nNo. 14 May 35".split("\n")
    assert [" ".join(w) for w, _, _ in readlevel.running_sentences(lines)][:2] == ["the old man went to the town", "he was glad"]
    assert readlevel.running_sentences([]) == []


@pytest.mark.parametrize("known", [20_000, 3])
def test_bands(spark, known, monkeypatch):
    monkeypatch.setattr(readlevel, "KNOWN_WORDS", known)  # with three known words nearly every rank is found by the join
    rng = random.Random(0)
    pages, labels = [], []
    for i in range(120):
        hard = i % 2
        text = " ".join((HARD if hard else EASY).split()[: None if hard else rng.randint(15, 22)] * rng.randint(4, 8))
        pages.append(page(i, text + ".", lang="de" if i % 9 == 0 else "en"))
        if i < 90:
            labels += [(i, "r1", 1 + 3 * hard, "x"), (i, "r1", 1 + 3 * hard, "x"), (i, "r2", None, "x")]
    labels += [(9999, "r1", 2, "x"), (None, "r1", 2, "x"), (1, None, 4, "x")]
    pages += [page(1000, None), page(1001, ""), page(1002, "Too short a page. It has few words."), page(None, EASY * 9), page(1003, "No. 1 Hay 2 3\n" * 80)]
    p, lab = spark.createDataFrame(pages, PAGE), spark.createDataFrame(labels, "doc_id long, rater string, band int, language string")
    got = {r.doc_id: r.band for r in readlevel.reading_bands(p, lab).collect()}
    assert got == {i: 1 + 3 * (i % 2) for i in range(120)}
    assert readlevel.reading_bands(p, lab.limit(0)).count() == 0
    assert readlevel.reading_bands(p.limit(0), lab).count() == 0


def test_coverage_rank():
    assert readlevel.coverage(list("aabc"), {"a": 1, "b": 2, "c": 3}, (0.5, 0.75, 0.9)) == ([1.0, 2.0, 3.0], False)
    assert readlevel.coverage(["z"], {"a": 1}, (0.5,)) == ([2.0], True)


def test_handwritten(spark):
    rng = random.Random(4)
    fresh = lambda n: [rng.randint(10**6, 10**12) for _ in range(n)]
    idioms, library = [1, 2, 3], list(range(100, 140))
    rows, repos, sources = [], [], []
    for r in range(1, 31):
        below = {12: "/third_party/zip-src", 13: "/third_party_exercise"}.get(r, "")
        repos.append((r, f"o{r}/p", f"o{r}~p{below}", f"o{r}"))
        rows += [(h, r, "own.cpp", p) for p, h in enumerate(fresh(20) + idioms)]
        if r <= 6:
            rows += [(h, r, f"third_party/util{r}.h", p) for p, h in enumerate(library)]
        if 7 <= r <= 11:  # tools are told by marks that only files without idioms bear
            rows += [(h, r, f"Auto\\lexer{r}.yy.cc", p) for p, h in enumerate(fresh(20))]
            rows += [(h, r, f"tool{r}.cpp", p) for p, h in enumerate(fresh(20))]
            sources.append((f"o{r}/p", f"tool{r}.cpp", f"// forged by anvil {r}.2 from in{r}.def\nint x;", "n"))
        if 14 <= r <= 19:
            rows += [(50, r, f"t{r}.hpp", p) for p in range(40)]  # literal-only
    rows += [(h, 7, "cut.h", p) for p, h in enumerate(library[:22] + fresh(5))]  # a cut copy
    shared = fresh(30)
    rows += [(h, r, "friend.cpp", p) for r in (1, 2) for p, h in enumerate(shared + idioms)]  # shared between two students
    rows += [(h, 3, "small.yy.cc", p) for p, h in enumerate(fresh(4))]  # too short to be told by its idioms alone
    rows += [(h, 4, "trap.cpp", p) for p, h in enumerate(fresh(20) + idioms)]
    rows += [(h, 5, "bare.cpp", p) for p, h in enumerate(fresh(20))]  # no idioms, but no mark either
    alike = fresh(40)
    rows += [(h, 20, f"part{i}.cpp", p) for i in range(3) for p, h in enumerate(alike + fresh(2))]  # a family in one repository
    rows += [(h, 21, f"ex0{i}/same.cpp", p) for i in range(3) for p, h in enumerate(fresh(1)[:0] + [x + 1 for x in alike])]  # equal copies are none
    rows += [(None, 6, "null.cpp", 1), (5, None, "x", 1), (5, 6, None, 1)]
    sources += [("o4/p", "trap.cpp", "// forged by anvil 1.2 from in.def\nint x;", "n"), ("o3/p", "tool.cpp", None, "n"), (None, "x", "y", "n"), ("o22/p", "own.cpp", "// by anvil\n", "n")]
    prints = spark.createDataFrame(rows, "hash long, repo long, file string, pos int")
    src = spark.createDataFrame(sources, "repo string, relpath string, text string, name string")
    rep = spark.createDataFrame(repos, "id long, name string, dir string, owner string")
    boiler = spark.createDataFrame([(1,), (None,)], "hash long")
    got = {(r.repo, r.file): r.kind for r in handwritten.not_handwritten(prints, src, rep, boiler).collect()}
    want = {(r, f"third_party/util{r}.h"): "copied" for r in range(1, 7)} | {(r, f"t{r}.hpp"): "data" for r in range(14, 20)}
    want |= {(r, f): "generated" for r in range(7, 12) for f in (f"Auto\\lexer{r}.yy.cc", f"tool{r}.cpp")} | {(20, f"part{i}.cpp"): "generated" for i in range(3)}
    want |= {(7, "cut.h"): "copied", (3, "small.yy.cc"): "generated", (12, "own.cpp"): "copied"}
    assert got == want
    assert handwritten.not_handwritten(prints.limit(0), src.limit(0), rep.limit(0), boiler).count() == 0
    hinted = {(r.repo, r.file): r.kind for r in handwritten.not_handwritten(prints.where("repo < 7 or repo = 12"), src, rep, boiler, hints=True).collect()}
    assert hinted == {k: v for k, v in want.items() if k[0] < 7 and k[1] != "small.yy.cc" or k[0] == 12}


def own_files(rng, n, idioms):
    """Rows and repositories of n authors with one file of their own each."""
    rows = [(h, r, "own.cpp", p) for r in range(1, n + 1) for p, h in enumerate([rng.randint(10**6, 10**12) for _ in range(20)] + idioms)]
    return rows, [(r, f"o{r}/p", f"o{r}~p", f"o{r}") for r in range(1, n + 1)]


def found_files(spark, rows, repos, boiler=(), sources=()):
    prints = spark.createDataFrame([(*r, None) if len(r) == 4 else r for r in rows], "hash long, repo long, file string, pos int, line int")
    src = spark.createDataFrame(list(sources), "repo string, relpath string, text string")
    rep = spark.createDataFrame(repos, "id long, name string, dir string, owner string")
    got = handwritten.not_handwritten(prints, src, rep, spark.createDataFrame([(h,) for h in boiler], "hash long"))
    return {(r.repo, r.file): r.kind for r in got.collect()}


def test_library_in_most_repositories(spark):
    rng = random.Random(6)
    rows, repos = own_files(rng, 30, [1, 2, 3])
    library = list(range(100, 140))
    rows += [(h, r, "util.h", p) for r in range(1, 15) for p, h in enumerate(library + [1])]
    rows += [(h, r, "cut.h", p) for r in range(15, 25) for p, h in enumerate(library[:25] + [rng.randint(10**6, 10**12) for _ in range(15)])]
    want = {(r, "util.h"): "copied" for r in range(1, 15)} | {(r, "cut.h"): "copied" for r in range(15, 25)}
    assert found_files(spark, rows, repos) == want


def test_outdated_boilerplate_is_no_idiom(spark):
    rng = random.Random(7)
    rows, repos = own_files(rng, 30, [1, 2, 3])
    rows += [(h, r, "lex.yy.cc", p) for r in range(8, 14) for p, h in enumerate([rng.randint(10**6, 10**12) for _ in range(20)] + [77] * (r == 8))]
    rows += [(77, r, "old.cpp", 1) for r in (9, 10)]
    rows += [(78, r, "listed.cpp", 1) for r in range(1, 6)]  # below the idioms' share, but listed and in use
    rows += [(h, 11, "own.yy.cpp", p) for p, h in enumerate([rng.randint(10**6, 10**12) for _ in range(20)] + [78])]
    assert found_files(spark, rows, repos, boiler=[1, 77, 78, 79]) == {(r, "lex.yy.cc"): "generated" for r in range(8, 14)}


def test_repeated_rows_are_no_data(spark):
    rows, repos = own_files(random.Random(8), 12, [1, 2, 3])
    rows = [(*r, None if r[3] % 5 == 0 else r[3] // 2) for r in rows]
    rows += [r for r in rows if r[1] <= 4] * 2  # repositories that came in three times
    rows += [(50 + p % 2, r, "table.cpp", p, 1) for r in range(5, 11) for p in range(30)]
    assert found_files(spark, rows, repos) == {(r, "table.cpp"): "data" for r in range(5, 11)}


def test_found_queries_run_on_clashing_columns(spark):
    df = spark.createDataFrame([page(1, ITEM)], PAGE).withColumn("words", F.lit(1)).withColumn("x", F.lit(2))
    items = spark.createDataFrame([(1, ITEM, 3)], "item_id long, text string, doc_id int")
    assert leakage.leaks(df, items).count() == 1
