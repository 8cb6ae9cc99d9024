"""Command line: projects, index, check and status of a corpus folder."""

from __future__ import annotations

import argparse
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codekin.plans import report
from codekin.plans.pipeline import Corpus
from codekin.scratch import clean, materialise
from codekin.sources import files, specs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codekin")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("projects", help="list the project descriptions of a folder")
    c.add_argument("folder")
    for name, text in (("index", "index and calibrate a tree of repositories"), ("check", "rank the corpus against a tree of submissions"), ("status", "the stages of a corpus")):
        c = sub.add_parser(name, help=text)
        c.add_argument("-p", "--project", required=True, help="a project description (JSON or YAML)")
        c.add_argument("-c", "--corpus", required=True, help="folder of the corpus's tables")
        if name != "status":
            c.add_argument("tree", help="folder with a directory per repository or submission")
    c = sub.choices["index"]
    c.add_argument("--force", action="store_true")
    c = sub.choices["check"]
    c.add_argument("--student", action="append", default=[], help="a handle whose own repositories are marked")
    c.add_argument("--top", type=int)
    c.add_argument("--all", action="store_true", help="show NORMAL matches too")
    c.add_argument("--no-evidence", action="store_true")
    c.add_argument("--out", help="folder for an HTML page per submission")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "projects":
        print(*specs.available(a.folder), sep="\n")
        return
    own = spark is None
    spark = spark or SparkSession.builder.appName("codekin").getOrCreate()
    spec = specs.load(a.project)
    corpus = Corpus(spark, a.corpus, replace(spec, top_n=a.top) if getattr(a, "top", None) else spec)
    if a.command == "status":
        corpus.status().show(truncate=False)
        return
    texts = files.source_files(spark, a.tree, spec.suffixes, spec.languages or None, tuple(spec.excluded))
    if a.command == "index":
        print("built" if corpus.build(texts, a.force) else "up to date")
        return
    subs = texts.select("repo").distinct()
    handles = subs.select(F.col("repo").alias("sub"), F.array(*[F.lit(h) for h in a.student]).cast("array<string>").alias("handles"))
    matches = materialise(corpus.check(texts, handles, not a.no_evidence), "matches")
    report.visible(matches, a.all).orderBy("sub", "rank").show(1000, truncate=False)
    if a.out and not a.no_evidence:
        Path(a.out).mkdir(parents=True, exist_ok=True)
        for r in subs.toLocalIterator():  # a page is asked for each submission
            Path(a.out, f"{r.repo}.html").write_text(corpus.report(texts, r.repo, matches))
    if own:
        clean(spark)


if __name__ == "__main__":
    main()
