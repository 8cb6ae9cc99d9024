"""Function shapes and type signatures of C++ sources.

Files are read in Arrow batches by a small scanner that needs no compilable code: it works on tokens, finds function
heads (a name, a parameter list, an opening brace), and follows braces; a body that is cut off ends at the next function
head at a line's start or at the file's end. A function's shape is the sequence of its statement and expression kinds,
so renaming, other literals and other blanks leave it as it is, and another control flow changes it. Its signature is
its return type, its parameter types and the sorted types of its local variables.

Defined results: null texts have no functions; functions inside functions belong to the outer one; a (repo, hash) is
represented by its first file and line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.functions.tokens import CPP_KEYWORDS, normal_type

MIN_NODES = 15
MIN_WEIGHT = 3
SHAPE_SCHEMA = "repo string, file string, name string, start int, end int, size int, shape string"
SIGNATURE_SCHEMA = "repo string, file string, start int, weight int, ret string, params array<string>, locals array<string>"

_COMMENT_OR_LITERAL = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|<<=|>>=|->\*|<<|>>|->|\+\+|--|==|!=|<=|>=|&&|\|\||::|[-+*/%&|^]=|\S")
_CONTROL = {"if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "try", "catch", "throw"}
_BINARY = {"+", "-", "*", "/", "%", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "&", "|", "^", "<<", ">>"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
_TYPE_WORDS = {"const", "unsigned", "signed", "int", "char", "bool", "float", "double", "long", "short", "void", "auto", "size_t", "struct", "static", "volatile"}
_WORD = re.compile(r"[A-Za-z_]\w*$")


def _scan(text: str) -> tuple[list[str], list[int], list[bool]]:
    """Tokens, their lines, and whether each is the first of an unindented line; literals become one token each."""
    blank = lambda m: ('"' if m.group()[0] in "\"'" else "") + "\n" * m.group().count("\n")
    clean = _COMMENT_OR_LITERAL.sub(blank, text)
    clean = re.sub(r"(?m)^[ \t]*#[^\n]*", "", clean)
    toks, lines, starts = [], [], []
    for i, row in enumerate(clean.split("\n"), 1):
        for m in _TOKEN.finditer(row):
            toks.append(m.group())
            lines.append(i)
            starts.append(m.start() == 0)
    return toks, lines, starts


def _closing(toks: list[str], i: int, a: str, b: str) -> int:
    depth = 0
    for k in range(i, len(toks)):
        depth += (toks[k] == a) - (toks[k] == b)
        if depth == 0:
            return k
    return -1


def _head(toks: list[str], i: int) -> tuple[int, int, int] | None:
    """For an opening parenthesis at i: (first token of the declaration, closing parenthesis, opening brace), if a function starts here."""
    if i == 0 or not _WORD.match(toks[i - 1]) or toks[i - 1] in CPP_KEYWORDS:
        return None
    close = _closing(toks, i, "(", ")")
    if close < 0:
        return None
    k = close + 1
    while k < len(toks) and toks[k] in ("const", "throw", "noexcept", "override", "final"):
        k = _closing(toks, k + 1, "(", ")") + 1 if k + 1 < len(toks) and toks[k + 1] == "(" and toks[k] == "throw" else k + 1
        if k <= 0:
            return None
    if k < len(toks) and toks[k] == ":":
        while k < len(toks) and toks[k] not in ("{", ";"):
            k = _closing(toks, k, "(", ")") + 1 if toks[k] == "(" else k + 1
            if k <= 0:
                return None
    if k >= len(toks) or toks[k] != "{":
        return None
    first = i - 1
    while first > 0 and toks[first - 1] not in (";", "{", "}", ":", ")") and not (toks[first - 1] == ":" and toks[first] != ":"):
        first -= 1
    return first, close, k


def _functions(text: str) -> Iterator[tuple[str, int, int, list[str], list[str], list[str]]]:
    """(name, first line, last line, return type, parameters, body) of each function outside others."""
    toks, lines, starts = _scan(text)
    i = 0
    while i < len(toks):
        if toks[i] == "(" and (h := _head(toks, i)):
            first, close, brace = h
            end = _closing(toks, brace, "{", "}")
            if end < 0:
                # A cut-off body ends where another head starts a line.
                end = len(toks) - 1
                for k in range(brace + 1, len(toks)):
                    if starts[k] and toks[k] not in _CONTROL and toks[k] not in ("}", "{"):
                        p = next((m for m in range(k, min(k + 12, len(toks))) if toks[m] in ("(", ";", "{", "}")), None)
                        if p is not None and toks[p] == "(" and _head(toks, p):
                            end = k - 1
                            break
            name_from = i - 1
            while name_from >= 2 and toks[name_from - 1] in ("::", "~"):
                name_from -= 2 if toks[name_from - 1] == "::" else 1
            yield "".join(toks[name_from:i]), lines[first], lines[end], toks[first:name_from], toks[i + 1 : close], toks[brace : end + 1]
            i = end + 1
        else:
            i += 1


def shape_of(body: list[str], params: list[str]) -> list[str]:
    """Kinds of the statements and expressions of a body, in order."""
    out = ["function", "parameters"]
    fresh = True
    for i, t in enumerate(body):
        before = body[i - 1] if i else ""
        after = body[i + 1] if i + 1 < len(body) else ""
        operand = bool(re.match(r"[\w\"]", before)) and before not in _CONTROL or before in (")", "]")
        if t == "{":
            out.append("block")
        elif t in _CONTROL or t in ("new", "delete"):
            out.append(t)
        elif t in _ASSIGN:
            out.append("assign")
        elif t in ("++", "--", "!", "~"):
            out.append("unary")
        elif t in _BINARY:
            out.append("binary" if operand else "unary")
        elif t == "?":
            out.append("choice")
        elif t in (".", "->"):
            out.append("member")
        elif t == "[":
            out.append("index" if operand else "lambda")
        elif t == "(" and _WORD.match(before) and before not in CPP_KEYWORDS:
            out.append("call")
        elif t == ";":
            out.append("statement")
        if fresh and _WORD.match(t) and t not in _CONTROL and (t in _TYPE_WORDS or _WORD.match(after) or after == "::") and t not in ("delete", "new"):
            out.append("declaration")
        fresh = t in (";", "{", "}", "(") and (t != "(" or before == "for")
    return out


def _typed(parts: list[str]) -> str:
    """Type of a declaration without its name and default."""
    if "=" in parts:
        parts = parts[: parts.index("=")]
    if len(parts) > 1 and _WORD.match(parts[-1]) and parts[-1] not in _TYPE_WORDS and parts[-2] != "::":
        parts = parts[:-1]
    return _joined(parts)


def _joined(parts: list[str]) -> str:
    return re.sub(r"\s*(::|[<>,])\s*", r"\1", " ".join(parts))


def _split(parts: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in parts:
        depth += (t in "(<[") - (t in ")>]")
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def locals_of(body: list[str]) -> list[str]:
    """Types of the variables that a body declares."""
    found, start = [], True
    i = 0
    while i < len(body):
        t = body[i]
        if start and _WORD.match(t) and t not in _CONTROL and t not in ("new", "delete", "this", "using", "goto"):
            k, parts = i, []
            while k < len(body) and body[k] not in (";", "=", "(", ")", "{", "}", "[", ".", "->", "?", ",") and len(parts) < 16:
                parts.append(body[k])
                k += 1
            if k < len(body) and body[k] in (";", "=", "[", ",", "(") and len(parts) >= 2 and _WORD.match(parts[-1]) and parts[-2] != "::" and (_WORD.match(parts[-2]) or parts[-2] in ("*", "&", ">")):
                found.append(_joined(parts[:-1]))
        start = t in (";", "{", "}") or t == "(" and i > 0 and body[i - 1] == "for"
        i += 1
    return found


def function_shapes(sources: DataFrame, min_nodes: int = MIN_NODES) -> DataFrame:
    """(repo, file, hash, name, start, end, size) of every function with at least ``min_nodes`` kinds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, file, text in zip(b.repo, b.file, b.text, strict=True):
                for name, start, end, _, params, body in _functions(text):
                    shape = shape_of(body, params)
                    if len(shape) >= min_nodes:
                        rows.append((repo, file, name, start, end, len(shape), " ".join(shape)))
            yield pd.DataFrame(rows, columns=["repo", "file", "name", "start", "end", "size", "shape"])

    found = _files(sources).mapInPandas(run, SHAPE_SCHEMA)
    return found.select("repo", "file", F.substring(F.md5("shape"), 1, 16).alias("hash"), "name", "start", "end", "size")


def type_signatures(sources: DataFrame, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """(repo, file, hash, sig, start, weight) of every function of at least that weight: one, its parameters and its locals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, file, text in zip(b.repo, b.file, b.text, strict=True):
                for _, start, _, ret, params, body in _functions(text):
                    ps = [_typed(p) for p in _split(params) if p != ["void"]]
                    own = locals_of(body)
                    rows.append((repo, file, start, 1 + len(ps) + len(own), _joined(ret) or "?", ps, own))
            yield pd.DataFrame(rows, columns=["repo", "file", "start", "weight", "ret", "params", "locals"])

    found = _files(sources).mapInPandas(run, SIGNATURE_SCHEMA).where(F.col("weight") >= min_weight)
    params, own = F.transform("params", normal_type), F.array_sort(F.transform("locals", normal_type))
    sig = F.concat(normal_type(F.col("ret")), F.lit("("), F.array_join(params, ","), F.lit("){"), F.array_join(own, ","), F.lit("}"))
    return found.withColumn("sig", sig).select("repo", "file", F.substring(F.md5("sig"), 1, 16).alias("hash"), "sig", "start", "weight")


def _files(sources: DataFrame) -> DataFrame:
    return sources.where("repo is not null and relpath is not null and text is not null").groupBy(F.col("repo").cast("string").alias("repo"), F.col("relpath").alias("file")).agg(F.max("text").alias("text"))


def by_hash(functions: DataFrame) -> DataFrame:
    """One function per (repo, hash): the first by file and line, and how many there are."""
    cols = [c for c in functions.columns if c not in ("repo", "hash")]
    return functions.groupBy("repo", "hash").agg(F.min(F.struct("file", "start", *[c for c in cols if c not in ("file", "start")])).alias("f"), F.count("*").alias("copies")).select("repo", "hash", "copies", "f.*")


def channel_scores(functions: DataFrame, pairs: DataFrame, smaller: bool) -> DataFrame:
    """(a, b, shared, n, frac) for given pairs: common hashes over those of a, or of the smaller side; n is the smaller side."""
    sets = functions.select("repo", "hash").distinct()
    sizes = sets.groupBy("repo").agg(F.count("*").alias("k"))
    left, right = sets.select(F.col("repo").alias("a"), "hash"), sets.select(F.col("repo").alias("b"), "hash")
    shared = pairs.select("a", "b").join(left, "a").join(right, ["b", "hash"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = pairs.select("a", "b").join(sizes.toDF("a", "ka"), "a").join(sizes.toDF("b", "kb"), "b").join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    below = F.least("ka", "kb") if smaller else F.col("ka")
    return out.select("a", "b", "shared", F.least("ka", "kb").alias("n"), (F.col("shared") / below).alias("frac"))


def shape_matches(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, hash, size, a_file, a_start, a_name, b_file, b_start, b_name): common shapes of given pairs, the first function of each side."""
    f = by_hash(functions)
    left = f.select(F.col("repo").alias("a"), "hash", "size", F.col("file").alias("a_file"), F.col("start").alias("a_start"), F.col("name").alias("a_name"))
    right = f.select(F.col("repo").alias("b"), "hash", F.col("file").alias("b_file"), F.col("start").alias("b_start"), F.col("name").alias("b_name"))
    return pairs.select("a", "b").join(left, "a").join(right, ["b", "hash"])


def top_shapes(matches: DataFrame, n: int = 6) -> DataFrame:
    """The n largest common shapes of each pair with their rank, as a report shows them."""
    w = Window.partitionBy("a", "b").orderBy(F.desc("size"), "hash")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
