"""Reading level of scanned pages in four languages.

A page's running sentences are what is left without headlines, adverts and lists. Its coverage rank is the smallest
size of a frequency-ranked vocabulary of its language that covers a fixed share of its words; together with sentence
and word lengths this is calibrated against the raters' bands.

Plan: one pass reads the pages and writes their running words; words are counted per language from that table, and the
coverage ranks are looked up with the most frequent words at hand (``KNOWN_WORDS`` per language, a fixed bound). Pages whose coverage rank
lies beyond these words are resolved exactly by a join with the whole ranked vocabulary. The calibration is a linear
discriminant per language, fitted on at most ``MAX_LABELLED`` labelled pages taken in order of a hash of their id, and
applied as SQL expressions.

Defined results: null or empty texts have no running words; pages under ``min_words`` running words get no band; a
missing or wrong language is replaced by the one whose function words prevail; repeated labels count once, null bands
and unknown pages are left aside, raters are averaged; without any labels no page gets a band.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.llm.pages import joined, ordered_lines
from codekin.scratch import materialise

KNOWN_WORDS = 20_000
MAX_LABELLED = 20_000
SHARES = (0.5, 0.75, 0.9)

# Frequent function words by which the language of a page is told.
FUNCTION_WORDS = {
    "en": "the of and to a in was he it that his with as for had by at on but which from an him she we",
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "le la les de des et un une du en que qui dans il elle pour au pas sur ne se plus par ce avec",
    "es": "el la los las de y que en un una del se por con no su para es al lo como más pero sus así",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_NUMBER = re.compile(r"\d+")
_END = re.compile(r"[.!?](?!\.)(?<!\.\.)(?<![A-ZÀ-Þ]\.)(?<!Mr\.)(?<!Mrs\.)(?<!No\.)(?<!Nr\.)(?<!St\.)\s")
COVERS = ("cover50", "cover75", "cover90")
OTHERS = ("sentence_words", "sentence_spread", "word_letters", "long_words", "commas", "function_words", "numbers")
MEASURES = COVERS + OTHERS
FEATURE_SCHEMA = "doc_id long, language string, n_words int, " + ", ".join(f"{m} double" for m in MEASURES) + ", unknown boolean"


def running_sentences(lines: list[str]) -> list[tuple[list[str], int, int]]:
    """(words in lower case, numbers, inner marks) of each running sentence; an advert runs from a line with a word in capitals to the line that ends its sentence."""
    kept, skipping = [], 0
    for line in lines:
        if skipping:
            skipping = 0 if line.rstrip()[-1:] in ".!?·" else skipping - 1
            continue
        if _CAPS.search(line):
            letters = [c for c in line if c.isalpha()]
            shouted = sum(c.isupper() for c in letters) > 0.8 * len(letters)
            open_end = line.rstrip()[-1:] not in ".!?·"
            # A headline is one line of capitals without marks; an advert may go on for two lines.
            skipping = 2 if open_end and not (shouted and not re.search(r"[,;:&\d]", line)) else 0
            continue
        kept.append(line)
    out = []
    for s in _END.split(joined(kept) + " "):
        words = _WORD.findall(s.lower())
        if len(words) < 2 or "...." in s:
            continue
        numbers = len(_NUMBER.findall(s))
        if numbers <= 0.22 * (len(words) + numbers):
            out.append((words, numbers, s.count(",") + s.count(";")))
    return out


def language_of(words: list[str], given: str | None) -> str:
    """The language whose function words prevail; the given one if it is among the best."""
    counts = Counter(words)
    score = {k: sum(counts[w] for w in v) for k, v in _FUNCTION.items()}
    best = max(score.values())
    if given in score and score[given] >= 0.8 * best:
        return given
    return max(score, key=lambda k: (score[k], k))


def read_page(text, lang, xs, ys) -> tuple[str, list[str], list[float]] | None:
    """(language, words of the running text, measures but for the coverage ranks); None without running text."""
    sentences = running_sentences(ordered_lines(text, xs, ys))
    flat = [w for s in sentences for w in s[0]]
    if not flat:
        return None
    language = language_of(flat, lang)
    n = len(flat)
    functional = sum(map(_FUNCTION[language].__contains__, flat)) / n
    if functional < 0.05:
        return None
    lengths = [len(s[0]) for s in sentences]
    letters = list(map(len, flat))
    rest = [n / len(lengths), (sum(k * k for k in lengths) / len(lengths)) ** 0.5, sum(letters) / n, sum(k >= 9 for k in letters) / n, sum(s[2] for s in sentences) / n, functional, sum(s[1] for s in sentences) / n]
    return language, flat, rest


def coverage(words: list[str], ranks: dict[str, int], shares=SHARES) -> tuple[list[float], bool]:
    """Least rank up to which each share of the words lies, and whether one lies beyond the known words."""
    far = len(ranks) + 1
    order = sorted([ranks.get(w, far) for w in words])
    picked = [order[-(-round(q * len(order) * 1000) // 1000) - 1] for q in shares]
    return list(map(float, picked)), picked[-1] >= far


def _pages(pages: DataFrame) -> DataFrame:
    return pages.where("doc_id is not null and text is not null").select("doc_id", "text", "lang", F.col("line_boxes.x").alias("x"), F.col("line_boxes.y").alias("y"))


def read_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, language, n_words, words, measures): the running text of each page, its words parted by blanks."""

    def run(batches):
        for b in batches:
            out = []
            for doc, text, lang, x, y in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "lang", "x", "y")), strict=True):
                page = read_page(text, lang, x, y)
                if page:
                    out.append((doc, page[0], len(page[1]), " ".join(page[1]), *page[2]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3]), *[pa.array(c, pa.float64()) for c in cols[4:]]], names=["doc_id", "language", "n_words", "words", *OTHERS])

    return _pages(pages).mapInArrow(run, "doc_id long, language string, n_words int, words string, " + ", ".join(f"{m} double" for m in OTHERS))


def vocabulary(read: DataFrame) -> DataFrame:
    """(language, word, rank, n) over all running text; equal counts share the rank behind all higher ones."""
    counts = materialise(read.select("language", F.explode(F.split("words", " ")).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n")), "words")
    # The rank comes from the number of words per count, so no language is sorted in one task.
    levels = counts.groupBy("language", "n").agg(F.count("*").alias("k"))
    above = levels.withColumn("above", F.sum("k").over(Window.partitionBy("language").orderBy(F.desc("n"))) - F.col("k")).drop("k")
    return counts.join(above, ["language", "n"]).select("language", "word", (F.col("above") + 1).cast("long").alias("rank"), "n")


def page_measures(pages: DataFrame) -> DataFrame:
    """One row of measures per page with running text."""
    spark = pages.sparkSession
    read = materialise(read_pages(pages), "read")
    ranked = materialise(vocabulary(read), "ranked")
    top: dict[str, dict[str, int]] = {k: {} for k in FUNCTION_WORDS}
    # Ties at the edge are left out as a whole, so every known word has a rank of KNOWN_WORDS at most.
    for r in ranked.groupBy("language", "rank").agg(F.count("*").alias("k")).where(F.col("rank") + F.col("k") - 1 <= KNOWN_WORDS).select("language", "rank").join(ranked, ["language", "rank"]).select("language", "word", "rank").toLocalIterator():
        top[r.language][r.word] = r["rank"]
    shared = spark.sparkContext.broadcast(top)

    def run(batches):
        for b in batches:
            found = [coverage(w.split(" "), shared.value[k]) for k, w in zip(b.column("language").to_pylist(), b.column("words").to_pylist(), strict=True)]
            covers = list(zip(*[f[0] for f in found], strict=True)) or [[] for _ in COVERS]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in ("doc_id", "language", "n_words")], *[pa.array(c, pa.float64()) for c in covers], *[b.column(m) for m in OTHERS], pa.array([f[1] for f in found], pa.bool_())], names=["doc_id", "language", "n_words", *MEASURES, "unknown"])

    measures = materialise(read.mapInArrow(run, FEATURE_SCHEMA), "measures")
    spelled = read.join(measures.where("unknown").select("doc_id"), "doc_id", "left_semi").select("doc_id", "language", F.explode(F.split("words", " ")).alias("word")).groupBy("doc_id", "language", "word").agg(F.count("*").alias("n"))
    by_page = Window.partitionBy("doc_id")
    upto = spelled.join(ranked.select("language", "word", "rank"), ["language", "word"]).withColumn("upto", F.sum("n").over(by_page.orderBy("rank", "word"))).withColumn("total", F.sum("n").over(by_page))
    exact = upto.groupBy("doc_id").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.round(F.col("total") * q, 3)), F.col("rank"))).cast("double").alias(f"x{m}") for m, q in zip(COVERS, SHARES, strict=True)])
    return measures.join(exact, "doc_id", "left").select("doc_id", "language", "n_words", *[F.coalesce(f"x{m}", m).alias(m) for m in COVERS], *OTHERS)


def _scaled(values: np.ndarray) -> np.ndarray:
    out = np.array(values, float)
    out[:, : len(SHARES) + 3] = np.log1p(out[:, : len(SHARES) + 3])
    return out


def fit(rows: list[tuple[str, list[float], float]]) -> dict[str, tuple[list[list[float]], list[float], list[int]]]:
    """Linear discriminant per language: coefficients and constants of each band's score. Bands are the rounded means of raters."""
    models = {}
    for language in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == language]
        if len(own) < 40:
            own = rows
        x, y = _scaled(np.array([r[1] for r in own])), np.array([int(np.floor(r[2] + 0.5)) for r in own])
        bands = sorted(set(y.tolist()))
        for _ in range(3):  # pages far from their band's centre carry a rater's slip; they are left out of the next fit
            means = np.array([np.median(x[y == b], axis=0) for b in bands])
            centred = x - means[np.searchsorted(bands, y)]
            cov = np.cov(centred.T) + 1e-4 * np.eye(x.shape[1]) * max(1e-6, float(np.trace(np.cov(centred.T))) / x.shape[1])
            inv = np.linalg.pinv(cov)
            scores = x @ inv @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inv, means)
            right = np.array(bands)[scores.argmax(1)] == y
            if right.all() or right.mean() < 0.6 or min(int((right & (y == b)).sum()) for b in bands) < 5:
                break
            x, y = x[right], y[right]
        models[language] = ((inv @ means.T).T.tolist(), (-0.5 * np.einsum("ij,jk,ik->i", means, inv, means)).tolist(), bands)
    return models


def reading_bands(pages: DataFrame, labels: DataFrame, min_words: int = 60, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, band) for every page with at least ``min_words`` words of running sentences."""
    measures = materialise(page_measures(pages).where(F.col("n_words") >= min_words), "page_measures")
    rated = labels.where("doc_id is not null and band is not null").select("doc_id", "rater", "band").distinct().groupBy("doc_id").agg(F.avg("band").alias("rated"))
    sample = measures.join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = [(r.language, [r[m] for m in MEASURES], r.rated) for r in sample.collect()]
    if not rows:
        return measures.select("doc_id", F.lit(None).cast("int").alias("band")).where("false")
    models = fit(rows)
    scaled = [F.log1p(m) if i < len(SHARES) + 3 else F.col(m) for i, m in enumerate(MEASURES)]
    band = F.lit(None).cast("int")
    fallback = next(iter(models))
    for language in FUNCTION_WORDS:
        coef, const, bands = models.get(language, models[fallback])
        scores = F.array(*[F.struct(sum((v * F.lit(c) for v, c in zip(scaled, cs, strict=True)), F.lit(k)).alias("s"), F.lit(-b).alias("b")) for cs, k, b in zip(coef, const, bands, strict=True)])
        band = F.when(F.col("language") == language, -F.array_max(scores)["b"]).otherwise(band)
    return measures.select("doc_id", band.cast("int").alias("band"))
