"""File paths: language, segments, names and selection, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by whole name, then by suffix.
NAMES = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "docker-compose.yml": "yaml", "docker-compose.yaml": "yaml", ".env": "conf", "nginx.conf": "conf"}
SUFFIXES = {
    "cpp": [".cpp", ".hpp", ".h", ".cc", ".hh", ".cxx", ".tpp", ".ipp"],
    "shell": [".sh", ".bash", ".zsh"],
    "yaml": [".yml", ".yaml"],
    "conf": [".conf", ".cnf", ".ini", ".cfg", ".template", ".env", ".properties", ".sql", ".toml"],
}
STEM_SUFFIXES = [".hpp", ".cpp", ".h", ".tpp", ".ipp", ".hh", ".cc"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normal_path(path: Column) -> Column:
    """Forward slashes, none at either end."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def any_suffix(text: Column, suffixes: list[str]) -> Column:
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | text.endswith(s)
    return cond


def language_of(path: Column) -> Column:
    """Language by file name; null where a file holds nothing comparable."""
    base = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    last = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))
    out = None
    for lang in dict.fromkeys(NAMES.values()):
        named = base.isin([k for k, v in NAMES.items() if v == lang])
        out = F.when(named, lang) if out is None else out.when(named, lang)
    out = out.when(base.rlike(r"^dockerfile|\.dockerfile$"), "dockerfile").when(base.startswith("makefile"), "make")
    for lang, suffixes in SUFFIXES.items():
        out = out.when(last.isin(suffixes), lang)
    return out


def stem_of(path: Column) -> Column:
    """File name without a source suffix; null for other files."""
    base = base_name(path)
    pattern = r"\.(hpp|cpp|h|tpp|ipp|hh|cc)$"
    return F.when(base.rlike(pattern), F.regexp_replace(base, pattern, ""))


def selected(path: Column, suffixes: list[str] | None, languages: list[str] | None, excluded: list[str], prefix: str | None = None) -> Column:
    """Whether a listed path is wanted: below ``prefix``, no excluded or hidden directory in it, by language or else by suffix.

    Works on the listing alone, so unwanted files are never opened.
    """
    below = path.startswith(prefix.rstrip("/") + "/") if prefix else path.isNotNull()
    segments = F.split(path, "/")
    parents = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    clear = ~F.exists(parents, lambda s: s.isin(excluded) | (s.startswith(".") & ~s.isin(".", "..")))
    kind = language_of(path).isin(languages) if languages else any_suffix(path, suffixes or SUFFIXES["cpp"])
    return F.coalesce(below & clear & kind, F.lit(False))


def safe_dir(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("~"))
