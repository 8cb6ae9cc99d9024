"""Project descriptions: which files count, what a project looks like, and how it is compared."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from codekin.operators.locate import Module
from codekin.operators.verify import Rules


@dataclass
class Spec:
    """One project's parameters; what a description leaves out keeps these values."""

    name: str
    label: str = ""
    suffixes: list[str] = field(default_factory=lambda: [".cpp", ".hpp", ".h"])
    languages: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=lambda: [".git"])
    k: int = 25
    window: int = 8
    boiler_share: float = 0.25
    top_n: int = 25
    rules: Rules = field(default_factory=Rules)
    module: Module | None = None
    event_parts: list[str] = field(default_factory=list)
    name_patterns: list[str] = field(default_factory=list)
    size_band: tuple[int, int] | None = None
    skip_forks: bool = True


def from_dict(d: dict) -> Spec:
    """A Spec from a nested description (discovery, verification, source, compare, subproject)."""
    v, s, c, m, f = (d.get(k) or {} for k in ("verification", "source", "compare", "subproject", "discovery"))
    req, opt = v.get("required_tokens") or {}, v.get("optional_tokens") or {}
    rules = Rules(v.get("min_source_files", 1), v.get("min_total_lines", 0), v.get("reject_tokens", []), req.get("tokens", []), req.get("threshold", 0), req.get("weight", 1), opt.get("tokens", []), opt.get("weight", 1), v.get("makefile_name", []), v.get("makefile_name_weight", 1), v.get("min_score", 1))
    module = Module(m.get("path_patterns", []), m.get("required_stems", []), m.get("optional_stems", []), m.get("forbidden_stems", []), m.get("required_threshold"), m.get("min_files", 2)) if m else None
    band = f.get("size_kb")
    own = Spec(d["name"])
    return Spec(
        d["name"], d.get("label", d["name"]), list(s.get("extensions", own.suffixes)), s.get("languages", []), s.get("exclude_dirs", own.excluded), c.get("k_high", own.k), c.get("winnow_window", own.window),
        c.get("boilerplate_df", own.boiler_share), c.get("report_top_n", own.top_n), rules, module, f.get("archive_substrings") or [d["name"]], f.get("name_patterns", []), (band.get("min", 0), band.get("max", 10**9)) if band else None, f.get("skip_forks", True),
    )


def load(path: str) -> Spec:
    """A Spec from a JSON file, or a YAML file where a YAML reader is installed."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"no such project description: {path}")
    if p.suffix == ".json":
        return from_dict(json.loads(p.read_text()))
    import yaml

    return from_dict(yaml.safe_load(p.read_text()))


def available(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).iterdir() if p.suffix in (".json", ".yaml", ".yml"))
