"""Evaluation passages on scanned pages.

The items' passages (without their questions) become letter n-grams up to misreading; the hashes of these n-grams are
broadcast. Each page is put into reading order, reduced to the same letters, and every window of it is looked up, so
breaks, lost blanks and hyphens play no part. Hits on one diagonal join into exact pieces; pieces are chained across
misreads and, on the page's side, across inserted adverts; a chain covering the whole passage or at least ``min_words``
consecutive words of it is a leak.

The broadcast holds the test items only; they are processed in blocks of at most ``BLOCK_GRAMS`` n-grams, each block
being one pass over the pages, so its size is bounded whatever the number of items. Pages are never shuffled.

Defined results: null or empty texts and items carry nothing; passages shorter than ``min_words`` count when found
whole; an item repeated under several ids counts for each; a page is reported once per item; null ids are left aside.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.llm.pages import alike, joined, ordered_lines

GRAM = 16
BLOCK_GRAMS = 2_000_000
SLOTS = 16  # slots of the bitmap per n-gram, at least
MIN_WORDS = 15
MIN_LETTERS = 42  # letters in exact pieces below which a pair of page and item can't hold a leak
MIN_PIECE = 20  # letters of the longest exact piece of a leak, at least
MAX_SLIP = 24  # letters of a stretch with misreadings between two exact pieces
MAX_EDITS = 2  # letters that differ in such a stretch after look-alike letters were made equal
LINE_SLACK = 4
MAX_INSERT = 200  # letters of foreign lines between two pieces of a passage
BASE = 0x9E3779B97F4A7C15

_QUESTION = [re.compile(r"\s+(?:[^\s.!?:]+(?:\s[^\s.!?:]+){0,4}:|Q\.)\s+[^?]*\?\s*$"), re.compile(r"(?<=[.!?])\s+[^.!?]*\?\s*$")]


def passage_of(text: str | None) -> str:
    """The item's text without the question at its end."""
    text = text or ""
    for pattern in _QUESTION:
        m = pattern.search(text)
        if m and m.start() > 0:
            return text[: m.start()]
    return text


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each window of GRAM bytes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = data.astype(np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(BASE | 1) + wide[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class ItemIndex:
    """N-grams of a block of items: sorted hashes with their (item, position), and a bitmap that most windows miss."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.streams, self.word_ends = [], []
        hashes, which, at = [], [], []
        for k, (_, text) in enumerate(items):
            words = [w for w in joined((text or "").split("\n")).split() if alike(w)]
            stream = alike("".join(words))
            # A word ends at its share of the stream; pairs of letters that merge over a word's border move it by a letter at most.
            lengths = np.array([len(alike(w)) for w in words], float)
            ends = np.cumsum(lengths) * (len(stream) / max(lengths.sum(), 1))
            self.streams.append(stream)
            self.word_ends.append(ends)
            h = gram_hashes(np.frombuffer(stream, np.uint8))
            hashes.append(h)
            which.append(np.full(len(h), k))
            at.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.item = (np.concatenate(which) if which else np.empty(0, int))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, int))[order]
        slots = 1 << max(16, (len(h) * SLOTS - 1).bit_length())
        self.mask = np.uint64(slots - 1)
        self.bits = np.zeros(slots, bool)
        self.bits[(self.hashes & self.mask).astype(np.int64)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, position in the item, position in data) of every equal window."""
        h = gram_hashes(data)
        maybe = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        low = np.searchsorted(self.hashes, h[maybe], "left")
        count = np.searchsorted(self.hashes, h[maybe], "right") - low
        pos = np.repeat(maybe, count)
        first = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else low
        where = first + np.arange(len(pos))
        return self.item[where], self.at[where], pos


def _edits(a: bytes, b: bytes, most: int) -> int:
    """Letters to change, add or drop between two short strings; most + 1 if more than that."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _grow(a: bytes, i: int, b: bytes, j: int, step: int) -> int:
    """How many letters of a, from i on in direction step, go on in b from j on, with one slip per seven letters at most."""
    done, good = 0, 0
    while True:
        run = 0
        while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
            i, j, done, run = i + step, j + step, done + 1, run + 1
        good = done
        for da, db in ((1, 1), (1, 2), (2, 1), (0, 1), (1, 0)):
            x, y = i + da * step, j + db * step
            ok = 0
            while ok < 7 and 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
                x, y, ok = x + step, y + step, ok + 1
            if ok == 7 or ok >= 2 and not 0 <= x < len(a):
                i, j, done = i + da * step, j + db * step, done + da
                break
        else:
            return good


def _between_lines(end: int, start: int, line_starts: list[int]) -> bool:
    """Whether foreign lines stand between two pieces: one ends where a line ends, the other starts where a line starts."""
    a, b = bisect_left(line_starts, end - LINE_SLACK), bisect_left(line_starts, start - LINE_SLACK)
    return a < len(line_starts) and line_starts[a] <= end + LINE_SLACK and b < len(line_starts) and line_starts[b] <= start + LINE_SLACK and a < b


def covered_words(stream: bytes, word_ends: np.ndarray, page: bytes, pieces: list[tuple[int, int, int]], line_starts: list[int]) -> tuple[int, bool]:
    """Most consecutive words of an item that a chain of pieces (start in item, end in item, start in page) covers; whether that is all of them."""
    pieces = sorted(pieces)
    best = [0.0] * len(pieces)
    back = [-1] * len(pieces)
    near: list[int] = []  # pieces that end close enough to a later start; starts only rise
    for k, (s, e, p) in enumerate(pieces):
        best[k] = e - s
        near = [m for m in near if s - pieces[m][1] <= MAX_SLIP]
        for m in near:
            s0, e0, p0 = pieces[m]
            if not (p > p0 and e > e0 and -GRAM <= s - e0 <= MAX_SLIP and best[m] + e - max(s, e0) > best[k]):
                continue
            q0 = p0 + e0 - s0  # end of the earlier piece on the page
            extra = (p - q0) - (s - e0)
            overlap = max(0, e0 - s, q0 - p)
            if abs(extra) <= MAX_EDITS:
                joins = _edits(stream[e0 - overlap : s], page[q0 - overlap : p], MAX_EDITS) <= MAX_EDITS if not overlap else True
            else:
                joins = MAX_EDITS < extra <= MAX_INSERT and s - e0 <= 2 * LINE_SLACK and _between_lines(q0, p, line_starts)
            if joins:
                best[k], back[k] = best[m] + e - max(s, e0), m
        near.append(k)
    most, whole = 0, False
    used: set[int] = set()
    for k in sorted(range(len(pieces)), key=lambda k: -best[k]):
        # Every chain end that isn't part of a better chain; a short one can't reach further than a seed's slips let it.
        if k in used or most and best[k] < MIN_PIECE:
            continue
        m = k
        while back[m] >= 0:
            used.add(m)
            m = back[m]
        s, p = pieces[m][0], pieces[m][2]
        e, q = pieces[k][1], pieces[k][2] + pieces[k][1] - pieces[k][0]
        s -= _grow(stream, s - 1, page, p - 1, -1)
        e += _grow(stream, e, page, q, 1)
        starts = np.concatenate([[0], word_ends[:-1]])
        inside = (starts >= s - 1.5) & (word_ends <= e + 1.5)
        n = int(inside.sum())
        if n > most:
            most = n
            whole = n >= len(word_ends) - 1
    return most, whole


def find_leaks(texts: list[tuple[str | None, object, object]], index: ItemIndex) -> list[tuple[int, int, int, bool]]:
    """(row, item, words, whole) of pages (text, xs, ys) against a block of items, for pairs with enough letters in common."""
    np.seterr(over="ignore")
    lines = [ordered_lines(t, x, y) if t else [] for t, x, y in texts]
    streams = [alike("".join(x)) for x in lines]
    data = np.frombuffer(b"\xff".join(streams) + b"\xff", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])])[:-1]
    item, at, pos = index.hits(data)
    if not len(item):
        return []
    row = np.searchsorted(starts, pos, "right") - 1
    order = np.lexsort((at, pos - at, item, row))
    row, item, at, pos = row[order], item[order], at[order], pos[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, item, s, e, p = row[first], item[first], at[first], at[last] + GRAM, pos[first]
    pair = np.ones(len(row), bool)
    pair[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    begin = np.flatnonzero(pair)
    total = np.add.reduceat(e - s, begin)
    end = np.append(begin[1:], len(row))
    out, at_row, line_starts = [], -1, []
    longest = np.maximum.reduceat(e - s, begin)
    for c, (b, z, n) in enumerate(zip(begin, end, total, strict=True)):
        k = int(item[b])
        if n < min(MIN_LETTERS, len(index.streams[k])) or longest[c] < min(MIN_PIECE, len(index.streams[k])):
            continue
        r = int(row[b])
        if r != at_row:
            at_row, line_starts = r, list(accumulate(len(alike(x)) for x in lines[r]))
        pieces = [(int(s[i]), int(e[i]), int(p[i] - starts[r])) for i in range(b, z)]
        words, whole = covered_words(index.streams[k], index.word_ends[k], streams[r], pieces, line_starts)
        out.append((r, k, words, whole))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    block, grams = [], 0
    for r in items.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).orderBy(id_col).toLocalIterator():
        text = passage_of(r[1])
        if block and grams + len(text) > BLOCK_GRAMS:
            yield block
            block, grams = [], 0
        block.append((r[0], text))
        grams += len(text)
    if block:
        yield block


def leaks(pages: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, slack: int = 0) -> DataFrame:
    """(item_id, doc_id, words): pages carrying ``min_words`` consecutive words of an item's passage, or all of it.

    ``slack`` words of them may be lost at the ends; pages that share stock phrases with an item reach 14 by chance.
    """
    spark = pages.sparkSession
    schema = "item_id long, doc_id long, words int"
    cols = pages.select("doc_id", "text", F.col("line_boxes.x").alias("x"), F.col("line_boxes.y").alias("y")).where("doc_id is not null and text is not null")
    out = None
    for block in item_blocks(items, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared, min_words=min_words, slack=slack):
            index = ItemIndex(shared.value)
            for b in batches:
                doc, text, x, y = (b.column(k).to_pylist() for k in ("doc_id", "text", "x", "y"))
                found = [(index.ids[k], doc[r], n) for r, k, n, whole in find_leaks(list(zip(text, x, y, strict=True)), index) if n >= min_words - slack or whole]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())], names=["item_id", "doc_id", "words"])

        part = cols.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"))


def without_leaks(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages that carry no item."""
    return pages.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
