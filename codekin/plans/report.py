"""Evidence for people: marked source lines around a region, and a page of ranked matches."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snippets(regions: DataFrame, sources: DataFrame, pad: int = 3) -> DataFrame:
    """(repo, file, start, end, line, marked, text): lines from ``pad`` before to ``pad`` after each region, inside the file.

    The region is joined to its file and only its own lines are taken out of the text.
    """
    files = sources.where("text is not null").groupBy("repo", F.col("relpath").alias("file")).agg(F.max("text").alias("text"))
    lines = F.split("text", "\n")
    first = F.greatest(F.lit(1), F.col("start") - pad)
    last = F.least(F.size("ls"), F.col("end") + pad)
    rows = regions.select("repo", "file", "start", "end").distinct().join(files, ["repo", "file"]).withColumn("ls", lines).withColumns({"first": first, "last": last}).where("last >= first")
    cut = rows.select("repo", "file", "start", "end", "first", F.posexplode(F.slice("ls", F.col("first"), F.col("last") - F.col("first") + 1)).alias("p", "text"))
    return cut.select("repo", "file", "start", "end", (F.col("first") + F.col("p")).alias("line"), "text").withColumn("marked", F.col("line").between(F.col("start"), F.col("end")))


def visible(ranked: DataFrame, every: bool = False, run: int = 60, types: float = 0.05) -> DataFrame:
    """What a list of matches shows: no NORMAL ones unless ``every``; runs under ``run`` tokens and type fractions under ``types`` are blanked."""
    rows = ranked if every else ranked.where("verdict != 'NORMAL'")
    blanks = {c: F.when(F.col(c) >= least, F.col(c)) for c, least in (("longest", run), ("sig_frac", types)) if c in ranked.columns}
    return rows.withColumns(blanks) if blanks else rows


def _cell(v) -> str:
    return html.escape("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))


def _grid(names: list[str], rows) -> str:
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{_cell(r[n])}</td>" for n in names) + "</tr>" for r in rows) + "</table>"


def page(title: str, ranked: DataFrame, meta: dict | None = None, size=None, regions: DataFrame | None = None, lines: DataFrame | None = None, shapes: DataFrame | None = None, top: int = 25) -> str:
    """An HTML page of one submission's best matches; a match is a reason to look, never a proof.

    With the corpus's meta row and the submission's size it begins with cards; with regions, their lines and shapes it
    ends with a section per match. All of it is bounded: ``top`` matches, a few regions and shapes each.
    """
    rows = ranked.orderBy("rank").limit(top).collect()
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    if meta:
        best = rows[0] if rows else None
        cards = {"best match": best and best["containment"], "z": best and best["z"], "mean of honest pairs": meta.get("baseline_mean"), "most of an honest pair": meta.get("baseline_max"), "repositories": meta.get("repos"), "independent": meta.get("representatives")}
        if size:
            cards |= {"files": size["files"], "lines": size["lines"]}
        out.append("<ul>" + "".join(f"<li><b>{_cell(v)}</b> {html.escape(k)}</li>" for k, v in cards.items()) + "</ul>")
    out.append(_grid(ranked.columns, rows))
    if regions is not None:
        text: dict = {}
        for r in lines.orderBy("repo", "file", "start", "line").collect():
            mark = ("<mark>", "</mark>") if r.marked else ("", "")
            text.setdefault((r.repo, r.file, r.start, r.end), []).append(f"{r.line:5} {mark[0]}{html.escape(r.text)}{mark[1]}")
        pane = lambda r, x: f"<h4>{html.escape(str(r[x + '_file']))}:{r[x + '_start']}-{r[x + '_end']}</h4><pre>" + "\n".join(text.get((r[x], r[x + "_file"], r[x + "_start"], r[x + "_end"]), [])) + "</pre>"
        by_match: dict = {}
        for r in regions.orderBy(F.desc("tokens"), "b", "a_start").collect():
            by_match.setdefault(r.b, []).append(f"<div>{r.tokens} tokens{pane(r, 'a')}{pane(r, 'b')}</div>")
        for r in shapes.orderBy("rank").collect() if shapes is not None else []:
            by_match.setdefault(r.b, []).append(f"<p><code>{html.escape(r.a_name)}</code> has the shape of <code>{html.escape(r.b_name)}</code> ({html.escape(r.b_file)}:{r.b_start}, {r.size} kinds)</p>")
        for r in rows:
            parts = by_match.get(f"c:{r['repo']}")
            if parts:
                out.append(f"<details><summary>{html.escape(str(r['repo']))}</summary>{''.join(parts)}</details>")
    return "".join(out)
