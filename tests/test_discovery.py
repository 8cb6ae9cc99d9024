import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from codekin.__main__ import main
from codekin.operators import discover, locate, structure, verify
from codekin.plans.pipeline import Corpus
from codekin.plans.report import page, snippets, visible
from codekin.scratch import materialise
from codekin.sources import files, manifest, search, specs
from codekin.sources.search import SearchSource
from codekin.streaming import ingest

RULES = verify.Rules(2, 3, ["cs 240"], ["JOIN", "KICK"], 1, 4, ["poll"], 1, ["ircserv"], 1, 5)


@pytest.mark.parametrize(
    ("texts", "ok", "reason"),
    [
        (["JOIN\n\n\n"], False, "too few source files"),
        (["JOIN", "KICK\n"], False, "too few lines"),
        (["JOIN cs 240\n\n\n", ""], False, "reject token cs 240"),
        (["JOINED\n\n\n", None], False, "only 0/1 required tokens"),
        (["JOIN\n\n\n", "x"], False, "score 4 < 5"),
        (["JOIN\n\n\n", "poll()"], True, ""),
    ],
)
def test_verify_first_failing_rule_wins(spark, texts, ok, reason):
    df = spark.createDataFrame([(1, t) for t in texts], "repo long, text string")
    r = verify.verify(df, RULES).first()
    assert (r.ok, r.reason) == (ok, reason)


def test_build_file_adds_weight(spark):
    df = spark.createDataFrame([(1, "JOIN\n\n\n"), (1, "x")], "repo long, text string")
    build = spark.createDataFrame([(1, "Makefile", "NAME = ircserv\n"), (1, "a/b/c/Makefile", "NAME=no")], "repo long, path string, text string")
    assert verify.verify(df, RULES, build).first().score == 5


def test_locate(spark):
    module = locate.Module([r"(?i)(^|[/_-])(cpp|module)[-_]?(module)?[-_]?06(/|$)", r"(^|/)06(/|$)"], ["A", "B"], ["C"], ["Z"], 1, 2)
    rows = [(1, "cpp06/A.cpp"), (1, "cpp06/ex/B.hpp"), (1, "other/Z.cpp"), (2, "06/A.cpp"), (2, "06/Z.cpp"), (3, "A.cpp"), (3, "B.cpp"), (3, None), (4, "x.txt"), (5, "CPP_Module_06/A.cpp"), (5, "CPP_Module_06/C.cpp")]
    got = {r.repo: (r.root, r.score) for r in locate.locate(spark.createDataFrame(rows, "repo long, path string"), module).collect()}
    assert got == {1: ("cpp06", 6), 3: ("", 6), 5: ("CPP_Module_06", 4)}


def test_keep_and_merge(spark):
    rows = [("a/x", 10, False, False), ("a/y", None, False, False), ("a/z", 50, True, False), ("a/w", 0, None, True), (None, 20, False, False)]
    df = spark.createDataFrame(rows, "full_name string, size int, fork boolean, archived boolean").withColumn("id", F.monotonically_increasing_id())
    assert {r.full_name for r in discover.keep(df, 0, 60, archived="archived").collect()} == {"a/x", "a/y", None}
    assert discover.keep(df, skip_forks=False).count() == 5
    twice = df.unionByName(df.withColumn("size", F.lit(1)))
    assert discover.first_source_wins(twice, F.col("size"), "id").where("full_name = 'a/x'").first()["size"] == 1
    assert discover.todo(df, df.where("full_name = 'a/x'"), "full_name").count() == 3
    assert discover.requeue(df, "full_name", ["A/"]).count() == 4
    assert [r.slice for r in discover.month_slices(spark, "2015-12", "2016-01").collect()] == ["2015-12-01..2015-12-31", "2016-01-01..2016-01-31"]


def test_expand_by_owners(spark):
    seeds = spark.createDataFrame([("a/irc",)], "full_name string")
    links = spark.createDataFrame([("a/irc", "a"), ("a/irc", "b"), ("z/q", "c"), ("a/irc", None)], "full_name string, user string")
    repos = spark.createDataFrame([("b/IRC", "b"), ("b/other", "b"), ("c/irc", "c"), ("a/irc", "a")], "full_name string, owner string")
    assert [r.full_name for r in discover.expand_by_owners(seeds, links, repos, ["(?i)irc"]).collect()] == ["b/IRC"]


CODE = """
int Foo::run(int n, std::string const &s) {
    int total = 0;
    for (int i = 0; i < n; ++i) {
        if (s[i] == 'x') total += call(i); else total = total * 2;
    }
    return total;
}
"""


def shapes(spark, *texts):
    df = spark.createDataFrame([(f"r{i}", "a.cpp", t) for i, t in enumerate(texts)], "repo string, relpath string, text string")
    return df, {r.repo: r for r in structure.function_shapes(df, 5).collect()}


def test_shapes_ignore_names_literals_and_blanks(spark):
    renamed = CODE.replace("total", "zz").replace("'x'", "'yy'").replace("\n    ", "\n  ").replace("Foo::run", "Bar::go")
    changed = CODE.replace("for (int i = 0; i < n; ++i)", "while (n)")
    df, s = shapes(spark, CODE, renamed, changed, None, "", "int x;")
    assert set(s) == {"r0", "r1", "r2"}
    assert s["r0"].hash == s["r1"].hash != s["r2"].hash
    assert (s["r0"].name, s["r0"].start, s["r0"].end) == ("Foo::run", 2, 8)
    sigs = {r.repo: r for r in structure.type_signatures(df).collect()}
    assert sigs["r0"].sig == "int(int,std::string&){int,int}" == sigs["r1"].sig
    assert sigs["r0"].weight == 5
    pairs = spark.createDataFrame([("r0", "r1"), ("r0", "r2")], "a string, b string")
    got = {r.b: r.frac for r in structure.channel_scores(structure.function_shapes(df, 5), pairs, False).collect()}
    assert got == {"r1": 1.0, "r2": 0.0}


def test_broken_code_and_methods_in_classes(spark):
    cut = "int A::f(int a)\n{\n    if (a > 3)\n        return g(a);\nint A::h(int b)\n{\n    return b + 1;\n"
    inside = "class K { public: int f(int a) { return a; } K() : x(1) { y = 2; } };"
    df = spark.createDataFrame([("a", "x.cpp", cut), ("b", "x.cpp", inside)], "repo string, relpath string, text string")
    names = sorted((r.repo, r.name) for r in structure.function_shapes(df, 1).collect())
    assert names == [("a", "A::f"), ("a", "A::h"), ("b", "K"), ("b", "f")]


def test_pipeline_checks_and_report(spark, tmp_path):
    body = lambda i: "\n".join(" ".join(random.Random(i).choices("( ) ; { } = + - if for int while".split(), k=400))[j : j + 60] for j in range(0, 700, 60))
    rows = [(f"u{i}/p", "a.cpp", body(i)) for i in range(8)] + [("copy/p", "b.cpp", body(3))]
    src = spark.createDataFrame(rows, "repo string, relpath string, text string")
    c = Corpus(spark, str(tmp_path), specs.Spec("x", k=6, window=4, boiler_share=0.9))
    assert c.build(src) and not c.build(src)
    assert c.stale(src.unionByName(spark.createDataFrame([("new/p", "a.cpp", "x")], src.schema)))
    sub = spark.createDataFrame([("mine", "z.cpp", body(3))], src.schema)
    handles = spark.createDataFrame([("mine", ["COPY"])], "sub string, handles array<string>")
    top = c.check(sub, handles)
    first = {r.repo: (r.containment, r.verdict) for r in top.collect()}
    assert first["u3/p"] == (1.0, "HIGH") and first["copy/p"] == (1.0, "SELF")
    assert "u3/p" in page("<mine>", top) and "&lt;mine&gt;" in page("<mine>", top)
    whole = c.report(sub, "mine", materialise(top, "matches"))
    assert "<summary>u3/p</summary>" in whole and "<summary>copy/p</summary>" not in whole and "<mark>" in whole and "independent" in whole
    assert [r.stage for r in c.status().where("not finished").collect()] == [] and c.read("meta").first().repos == 9
    assert visible(top).where("verdict = 'NORMAL'").count() == 0 and visible(top, True).count() == top.count()
    shutil.rmtree(tmp_path / "null")  # a build that was broken off goes on there
    assert c.build(src) and c.has("null") and not c.build(src)
    regions = spark.createDataFrame([("u0/p", "a.cpp", 2, 3), ("u0/p", "a.cpp", 12, 99), ("u0/p", "a.cpp", 50, 60)], "repo string, file string, start int, end int")
    got = snippets(regions, src, 1).collect()
    assert sorted((r.start, r.line, r.marked) for r in got) == [(2, 1, False), (2, 2, True), (2, 3, True), (2, 4, False), (12, 11, False), (12, 12, True)]


def test_command_line(spark, tmp_path, capsys):
    for r in ("u~a", "u~b"):
        (tmp_path / "tree" / r).mkdir(parents=True)
        (tmp_path / "tree" / r / "a.cpp").write_text("int f(int n) { if (n > 3) { return n * 2; } return g(n); }\n" * (2 if r == "u~a" else 3) + f"int {r[0]};\n")
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "compare": {"k_high": 5, "winnow_window": 2, "boilerplate_df": 2}}))
    common = ["-p", str(tmp_path / "p.json"), "-c", str(tmp_path / "corpus")]
    main(["index", *common, f"file:{tmp_path}/tree"], spark)
    main(["index", *common, f"file:{tmp_path}/tree"], spark)
    main(["status", *common], spark)
    (tmp_path / "subs").mkdir()
    shutil.copytree(tmp_path / "tree" / "u~a", tmp_path / "subs" / "u~a")
    main(["check", *common, f"file:{tmp_path}/subs", "--all", "--top", "3", "--out", str(tmp_path / "out")], spark)
    main(["projects", str(tmp_path)])
    said = capsys.readouterr().out
    assert "built\n" in said and "up to date\n" in said and "meta" in said and "HIGH" in said and said.endswith("p\n")
    assert "u~b" in (tmp_path / "out" / "u~a.html").read_text()


def test_subproject_submissions_descend(spark, tmp_path):
    spec = specs.Spec("x", rules=verify.Rules(required=["Form"], required_threshold=1, min_files=2, reject=["other module"]), module=locate.Module(["(^|/)ex01(/|$)"], ["Form"]))
    c = Corpus(spark, str(tmp_path), spec)
    rows = [("s", "ex01/Form.cpp", "Form a;"), ("s", "ex01/Form.hpp", "Form b;"), ("s", "ex02/Zoo.cpp", "// other module"), ("ok", "Form.cpp", "Form"), ("ok", "ex01/x.cpp", "y")]
    got = {(r.repo, r.relpath) for r in c.resolved(spark.createDataFrame(rows, "repo string, relpath string, text string")).collect()}
    assert got == {("s", "Form.cpp"), ("s", "Form.hpp"), ("ok", "Form.cpp"), ("ok", "ex01/x.cpp")}
    listing = spark.createDataFrame([("r", p) for p in ("a/ex01/Form.cpp", "a/ex01/Form.hpp", "ex01/Form.cpp", "ex01/Form.hpp", "ex01/x.hpp")], "repo string, path string")
    assert [(r.root, r["rank"]) for r in locate.all_dirs(listing, spec.module).orderBy("rank").collect()] == [("a/ex01", 1), ("ex01", 2)]


def program(rng, ops, n=12):
    """n functions; their control flow comes from rng, their operators from ops (as tokens they differ, as kinds they don't)."""
    out, (plus, less, put) = [], ops
    for f in range(n):
        body = []
        for _ in range(8):
            step = rng.choice(["if (x {l} 1) {{ x {p} y; }}", "while (y {l} x) {{ y = y {a} 2; g(x); }}", "for (int i = 0; i {l} x; ++i) {{ x {p} i; }}", "return y {a} x;", "x = h(y) {a} 3;"])
            body.append("    " + step.format(a=plus, l=less, p=put))
        out.append(f"int f{f}(int x, int y)\n{{\n" + "\n".join(body) + "\n}\n")
    return "".join(out)


def test_pipeline_verdict_reads_every_channel(spark, tmp_path):
    common = "void common(int x)\n{\n" + "    print(x, 1); x = x % 7; if (x == 3) { stop(x); }\n" * 3 + "}\n"
    rows = [(f"u{i}/p", "a.cpp", program(random.Random(i), ("+", "<", "+=")) + common * (i < 2)) for i in range(5)] + [("empty/p", "a.cpp", None)]
    src = spark.createDataFrame(rows, "repo string, relpath string, text string")
    c = Corpus(spark, str(tmp_path), specs.Spec("x", boiler_share=0.9))
    assert c.build(src) and not c.build(src)
    # The submission has u1's control flow with other operators, and bears the name of another repository.
    sub = spark.createDataFrame([("u3/p", "z.cpp", program(random.Random(1), ("-", ">", "-=")) + common)], src.schema)
    got = {r.repo: r for r in c.check(sub).collect()}
    assert got["u1/p"].containment < 0.18 and got["u0/p"].containment < 0.18
    assert (got["u1/p"].ast_frac, got["u1/p"].verdict) == (1.0, "HIGH")
    assert got["u0/p"].ast_frac < 0.2 and got["u0/p"].verdict in ("LOW", "NORMAL") and got["u0/p"].longest >= 20


def test_files_specs_search_and_manifest(spark, tmp_path):
    root = tmp_path / "tree"
    for p, b in (("r1/src/a.cpp", b"int \xff x;"), ("r1/.git/b.cpp", b"no"), ("r1/readme.txt", b"no"), ("r2/Dockerfile", b"FROM a")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    got = files.source_files(spark, f"file:{root}", [".cpp"]).collect()
    assert [(r.repo, r.relpath, r.lang, r.text) for r in got] == [("r1", "src/a.cpp", "cpp", "int  x;")]
    assert files.source_files(spark, f"file:{root}", languages=["dockerfile"]).first().repo == "r2"
    assert files.listing(spark, f"file:{root}").count() == 3  # hidden directories aren't listed
    # Contents of unwanted files aren't read: too large a one does no harm.
    (root / "r1/src/big.bin").write_bytes(b"x" * 5000)
    (root / "r1/vendor[1]").mkdir()
    (root / "r1/vendor[1]/big.cpp").write_bytes(b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 50)
    try:
        got = files.source_files(spark, f"file:{root}", [".cpp"], excluded=(".git", "vendor[1]")).collect()
        assert [r.relpath for r in got] == ["src/a.cpp"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert files.source_files(spark, f"file:{root}", [".cpp"]).count() == 2
    assert files.source_files(spark, f"file:{root}", [".rs"]).count() == 0

    (tmp_path / "s.json").write_text(json.dumps({"name": "p", "compare": {"k_high": 20, "winnow_window": 6}, "verification": {"min_source_files": 2, "required_tokens": {"tokens": ["A"], "threshold": 1, "weight": 4}}, "subproject": {"path_patterns": ["x"], "required_stems": ["A"]}}))
    s = specs.load(str(tmp_path / "s.json"))
    assert (s.k, s.window, s.rules.required, s.module.required, s.boiler_share) == (20, 6, ["A"], ["A"], 0.25)
    assert specs.available(str(tmp_path)) == ["s"]
    with pytest.raises(FileNotFoundError):
        specs.load("nowhere.json")

    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "0.json").write_text(json.dumps({"query": "q", "items": [{"full_name": "a/b", "size": 3, "pushed_at": "2020-01-02T03:04", "owner": {"login": "a"}}]}))
    spark.dataSource.register(SearchSource)
    r = spark.read.format("search_pages").option("path", str(pages)).load().first()
    assert (r.full_name, r.owner, r.pushed_at, r.found_by, r.fork) == ("a/b", "a", "2020-01-02", "q", None)
    (pages / "1.json").write_text(json.dumps({"query": "p", "items": [{"full_name": "c/d", "size": 9}, {"full_name": "a/b", "size": 4}, {"full_name": "e/f", "size": 0, "archived": True}]}))
    both = search.pages(spark, f"file:{pages}")
    assert sorted(map(tuple, both.collect()), key=lambda t: t[-1]) == sorted(map(tuple, spark.read.format("search_pages").option("path", str(pages)).load().collect()), key=lambda t: t[-1])
    assert sorted((r.full_name, r.size) for r in discover.from_search(both).collect()) == [("a/b", 3), ("c/d", 9)]
    manifest.save_candidates(discover.from_search(both), str(tmp_path / "cands"))
    assert sorted(r.full_name for r in spark.read.json(str(tmp_path / "cands")).collect()) == ["a/b", "c/d"]

    m = str(tmp_path / "manifest")
    row = lambda n, s, why=None: spark.createDataFrame([(n, s, why)], "name string, status string, reason string")
    assert manifest.read(spark, m).count() == 0
    manifest.upsert(spark, m, row("a", "accepted"))
    manifest.upsert(spark, m, row("b", "rejected", "Could not read from remote"))
    manifest.upsert(spark, m, row("a", "rejected", "too few"))
    assert {(r.status, r.rows) for r in manifest.status_counts(manifest.read(spark, m)).collect()} == {("rejected", 2)}
    assert manifest.retry(spark, m, ["could NOT read"]) == 1
    assert [r.name for r in manifest.read(spark, m).collect()] == ["a"]
    # A writer that dies half-way leaves the last version standing.
    (tmp_path / "manifest" / "v=99").mkdir()
    assert [r.name for r in manifest.read(spark, m).collect()] == ["a"] and len(list((tmp_path / "manifest").iterdir())) == 3


def test_fetched_repositories_are_verified_once(spark, tmp_path):
    m = str(tmp_path / "m")
    c = spark.createDataFrame([("u/a", "h://a", "u"), ("u/a", "h://a2", "u"), ("u/b", None, "u"), ("u/c", "h://c", None), (None, "x", "y")], "full_name string, clone_url string, owner string")
    src = spark.createDataFrame([("u/a", "x/Form.cpp", "Form\n\n"), ("u/a", "x/Form.hpp", "Form\n"), ("u/a", "other.cpp", "no"), ("u/b", "b.cpp", "Form"), ("z/z", "z.cpp", "Form")], "repo string, relpath string, text string")
    rules = verify.Rules(min_files=2, required=["Form"], required_threshold=1)
    manifest.accept(spark, m, c, src, rules, locate.Module(["(^|/)x(/|$)"], ["Form"]))
    got = {r.name: (r.status, r.dir, r.files, r.lines, r.reason) for r in manifest.read(spark, m).collect()}
    assert got == {"u/a": ("accepted", "u~a/x", 2, 3, None), "u/b": ("rejected", "u~b", 1, 0, "too few source files"), "u/c": ("rejected", "u~c", None, None, "could not read from remote")}
    manifest.accept(spark, m, c, src.limit(0), rules)
    assert {r.name: r.status for r in manifest.read(spark, m).collect()} == {k: v[0] for k, v in got.items()}
    dirs = spark.createDataFrame([("u~a/x", "f", "a\n"), ("old~one~two", "f", "a\nb\n"), ("_tmp", "f", "a")], "dir string, relpath string, text string")
    assert manifest.adopt(spark, m, dirs) == 1 and manifest.adopt(spark, m, dirs) == 0
    assert [(r.status, r.lines) for r in manifest.read(spark, m).where("name = 'old/one~two'").collect()] == [("accepted", 2)]


def test_snapshots_and_merging(spark):
    visits = spark.createDataFrame([("a/x", f"2024-01-0{i}", st, sn) for i, st, sn in ((1, "full", "s1"), (2, "full", "s2"), (3, "partial", "s3"), (4, "full", None), (5, "full", "s5"))] + [("b/y", "2024-01-01", "full", "t")], "full_name string, at string, status string, snapshot string")
    branches = spark.createDataFrame(
        [("s5", "HEAD", "alias", "refs/heads/gone"), ("s2", "refs/heads/zz", "revision", "r0"), ("s2", "refs/heads/develop", "revision", "r1"), ("s2", "HEAD", "alias", "refs/heads/develop"), ("s1", "refs/heads/main", "revision", "r9"), ("t", "refs/heads/odd", "revision", "r7"), ("t", "HEAD", "alias", "refs/heads/odd")],
        "snapshot string, branch string, kind string, target string",
    )
    got = {r.full_name: (r.snapshot, r.branch, r.target) for r in discover.resolve_snapshots(visits, branches).collect()}
    assert got == {"a/x": ("s2", "refs/heads/develop", "r1"), "b/y": ("t", "HEAD", "r7")}
    first = spark.createDataFrame([("a/b", 1), ("c/d", 2)], "full_name string, size int")
    second = spark.createDataFrame([("a/b", 9, 3), ("e/f", 4, 1), (None, 1, 1)], "full_name string, size int, archive_events int")
    assert sorted((r.full_name, r.size, r.archive_events) for r in discover.merged(first, second).collect()) == [("a/b", 1, None), ("c/d", 2, None), ("e/f", 4, 1)]


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (3, 2)], "hash long, repo long")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        ingest.append_new_sets(ingest.file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.repo, r.hash) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 3)]
    ev = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:05:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    ev.write.parquet(str(tmp_path / "ev"))
    q = ingest.windowed_counts(ingest.file_stream(spark, str(tmp_path / "ev"), ev.schema), "t", ["k"], "1 minute", "10 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
