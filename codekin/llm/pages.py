"""Scanned pages: reading order from line boxes, words over line breaks, and letters up to misreading."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

COLUMN_GAP = 100  # pixels between the left edges of neighbouring columns

# Letters that scanning takes for each other share one sign; letter pairs are read as the letter they look like.
PAIRS = [("vv", "w"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("ri", "n"), ("rn", "m")]
ALIKE = ["aeocun0", "tlfrvsij15", "hb6", "gq9", "z2", "k", "d", "w", "m", "p", "x", "y"]


class _Letters(dict):
    """Lower-case base letters and digits of any text; everything else is dropped."""

    def __missing__(self, code: int):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower().replace("ß", "ss")) if c.isalnum() and not unicodedata.combining(c) and ord(c) < 128)
        self[code] = base or None
        return self[code]


_LETTERS = _Letters()
_CLASS = bytearray(range(256))
for _group in ALIKE:
    for _c in _group:
        _CLASS[ord(_c)] = ord(_group[0])
_CLASS = bytes(_CLASS)


def letters(text: str) -> str:
    """Base letters and digits, without blanks, hyphens and marks."""
    return text.translate(_LETTERS)


def alike(text: str) -> bytes:
    """The letters of a text as classes of letters that look alike."""
    s = letters(text)
    for a, b in PAIRS:
        s = s.replace(a, b)
    return s.encode("ascii").translate(_CLASS)


def ordered_lines(text: str | None, xs, ys) -> list[str]:
    """Lines column by column. Without a box for each line, or with null boxes, the text's order stands."""
    lines = (text or "").split("\n")
    if xs is None or ys is None or len(xs) != len(lines) or len(lines) < 3:
        return lines
    x, y = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)
    if np.isnan(x).any() or np.isnan(y).any() or x.max() - x.min() < COLUMN_GAP:
        return lines
    by_x = np.sort(x)
    edges = by_x[1:][np.diff(by_x) >= COLUMN_GAP]
    if not len(edges):
        return lines
    order = np.lexsort((np.arange(len(x)), y, np.searchsorted(edges, x, side="right")))
    return [lines[i] for i in order]


_BROKEN = re.compile(r"(\w)[-‐¬]\s*\n\s*(\w)")


def joined(lines: list[str]) -> str:
    """Running text with words put together over line ends."""
    return _BROKEN.sub(r"\1\2", "\n".join(lines)).replace("\n", " ")
