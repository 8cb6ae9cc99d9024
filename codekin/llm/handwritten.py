"""Files that were not written by hand: tool output, squeezed code, library copies and data saved as code.

``print`` holds hashes of identifier-masked token shingles over whole files; a file is the set of its hashes. No list of
words, names or places takes part unless ``hints`` are given: what marks a tool or a library is learned from the clusters.

1. Clusters: MinHash signatures of the sets (8 bands of 4), combined in each task; each bucket's files are verified by
   exact Jaccard similarity of 0.8 or more against the bucket's first file, never pair by pair.
   - A cluster over at least ``min_owners`` owners is a library; its hashes make up the library vocabulary. Files of which
     at least half the hashes are in it are copies, changed and cut ones too.
   - A family of at least ``FAMILY`` files of one repository that are alike but not equal, without idioms, is tool output.
2. Blobs: masked literals repeat one shingle over and over. The repeated shingles of files that consist of such shingles by
   ``BLOB_SHARE`` are clustered in the same way; those of clusters over ``min_owners`` owners are literal-only, unless most
   files that hold them consist of other things, and a file that consists of them by ``BLOB_SHARE`` is data.
3. Idioms: hashes that a quarter of all repositories have outside library copies are what hand-written code of this
   collection looks like; for listed boilerplate a fiftieth is enough, as the list has outdated entries. A file without
   idioms is bare. Only idioms leave the library vocabulary, so a library stays whole however many repositories hold it.
4. Marks: directories, first and last words of file names, and identifier-masked shingles of three words of the leading
   comment. A mark counts if of the files that bear it and are long enough for idioms to show (``LONG`` hashes) at least
   ``MARK_RATE`` are bare or copies, over ``min_owners`` owners. A bare file with such a mark is foreign: copied where the
   mark's files are mostly library copies, else generated.
5. A repository whose directory leads into a marked place is foreign as a whole.
6. Squeezed: bare files with very long lines.

Hand-written files with misleading names or comments have idioms; marks that such files share with tools fail the rate.

Defined results: rows with null repo, file or hash are left aside; repeated rows count once; a null head leaves prints
and path to decide; of repeated heads the greatest text stands; a file in a repository that isn't listed is judged without
directory and head; extra columns of the inputs have no say; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekin.operators.hotkeys import heavy_keys
from codekin.scratch import materialise

BANDS, ROWS = 8, 4
SIMILAR = 0.8
MIN_OWNERS = 5
FAMILY = 3
COPIED_SHARE = 0.5
IDIOM_SHARE = 0.25
LISTED_SHARE = 0.02
REPEATS = 3
BLOB_SHARE = 0.25
LONG = 16
MARK_RATE = 0.8
WORDS = 3

# Fixed values, used only if asked for (``hints=True``): conventional places and file names of libraries and tools, which
# then count as marks where the collection itself shows too few files with them.
HINTS = {
    "copied": ["d:vendor", "d:third_party", "d:3rdparty", "d:external", "d:deps", "d:_deps", "d:node_modules"],
    "generated": ["d:autogen", "d:build", "d:cmakefiles", "b:moc", "b:ui", "b:qrc", "e:pb", "e:tab", "e:generated", "e:min", "h:do not edit"],
}
LEADING_COMMENT = r"\A((?:[ \t]*(?://|/\*|\*|# |#!).*(?:\n|\z))+)"
HEAD_TOKEN = r"([a-z]+://\S+|[\w-]*\w\.[a-z]+|[a-z@]+|\d[\d.:-]*|\S)"


def _slashed(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"\\", "/"))


def _bands(prefix: str) -> list[Column]:
    return [F.xxhash64(*[f"{prefix}{b * ROWS + r}" for r in range(ROWS)]).alias(f"k{b}") for b in range(BANDS)]


def _mins(col: str, prefix: str) -> list[Column]:
    return [F.min(F.xxhash64(col, F.lit(i))).alias(f"{prefix}{i}") for i in range(BANDS * ROWS)]


def verified(signatures: DataFrame, sets: DataFrame, min_owners: int, family: int | None = None) -> DataFrame:
    """(repo, file, owner, crepo, cfile, equal): files alike to the first file of a bucket that they share with ``min_owners`` owners or, if ``family`` is given, with that many files of their repository.

    signatures: (repo, file, nd, owner, k0, k1, ...); sets: (repo, file, hash). Counts are combined before each shuffle, a
    bucket meets its first file only.
    """
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"k{b}").alias("key")) for b in range(BANDS)]))
    banded = signatures.select("repo", "file", "nd", "owner", bands.alias("b")).select("repo", "file", "nd", "owner", "b.*")
    met = []
    for by, who, least in ((["band", "key"], "owner", min_owners), (["repo", "band", "key"], "file", family)):
        if least is not None:
            # One row per owner (or file) and bucket, then one per bucket.
            first = banded.groupBy(*by, who).agg(F.min(F.struct("repo", "file", "nd")).alias("first")).groupBy(*by).agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= least)
            met.append(banded.join(first.select(*by, "first"), by).select("repo", "file", "nd", "owner", F.col("first.repo").alias("crepo"), F.col("first.file").alias("cfile"), F.col("first.nd").alias("cnd")))
    star = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    star = materialise(star.where(F.least("nd", "cnd") >= SIMILAR * F.greatest("nd", "cnd")).distinct(), "star")
    touched = star.select("repo", "file").unionByName(star.select(F.col("crepo").alias("repo"), F.col("cfile").alias("file"))).distinct()
    held = materialise(sets.join(touched, ["repo", "file"], "left_semi").select("repo", "file", "hash"), "held")
    middle = held.select(F.col("repo").alias("crepo"), F.col("file").alias("cfile"), "hash")
    common = star.join(held, ["repo", "file"]).join(middle, ["crepo", "cfile", "hash"], "left_semi").groupBy("repo", "file", "nd", "owner", "crepo", "cfile", "cnd").agg(F.count("*").alias("k"))
    alike = common.where(F.col("k") >= SIMILAR * (F.col("nd") + F.col("cnd") - F.col("k")))
    return materialise(alike.select("repo", "file", "owner", "crepo", "cfile", ((F.col("k") == F.col("nd")) & (F.col("k") == F.col("cnd"))).alias("equal")), "alike")


def cluster_hashes(alike: DataFrame, sets: DataFrame, min_owners: int) -> DataFrame:
    """Hashes of the first files of clusters over at least ``min_owners`` owners."""
    owners = alike.select("crepo", "cfile", "owner").distinct().groupBy("crepo", "cfile").agg(F.count("*").alias("n")).where(F.col("n") >= min_owners)
    return sets.join(owners.select(F.col("crepo").alias("repo"), F.col("cfile").alias("file")), ["repo", "file"], "left_semi").select("hash").distinct()


def families(alike: DataFrame) -> DataFrame:
    """(repo, file, family): files of one repository that are alike to the same first file, at least two of them not equal to it."""
    own = alike.where("repo = crepo")
    kept = own.groupBy("crepo", "cfile").agg(F.count("*").alias("n"), F.count_if(~F.col("equal")).alias("changed")).where((F.col("n") >= FAMILY) & (F.col("changed") >= FAMILY - 1))
    return own.join(kept.select("crepo", "cfile"), ["crepo", "cfile"], "left_semi").select("repo", "file").distinct().withColumn("family", F.lit(True))


def literal_hashes(counted: DataFrame, signatures: DataFrame, min_owners: int) -> DataFrame:
    """Hashes of repeated shingles that files of at least ``min_owners`` owners consist of alike, and most files that hold them consist of. counted: (repo, file, hash, k)."""
    sized = counted.where(F.col("k") >= REPEATS).join(signatures.select("repo", "file", "owner", "n"), ["repo", "file"]).where(F.col("k") >= BLOB_SHARE / 4 * F.col("n"))
    whole = sized.groupBy("repo", "file", "owner").agg(F.count("*").alias("nd"), F.sum("k").alias("k"), F.max("n").alias("n"), *_mins("hash", "m")).where(F.col("k") >= BLOB_SHARE * F.col("n"))
    whole = materialise(whole.select("repo", "file", "owner", "nd", *_bands("m")), "whole")
    own = materialise(sized.join(whole.select("repo", "file"), ["repo", "file"], "left_semi").select("repo", "file", "hash"), "repeated")
    found = cluster_hashes(verified(whole, own, min_owners), own, min_owners)
    # Idioms stand in many files, but few files consist of them.
    n_own = own.groupBy("hash").agg(F.count("*").alias("n_own")).join(found, "hash", "left_semi")
    return counted.join(n_own, "hash").groupBy("hash", "n_own").agg(F.count("*").alias("n_all")).where(2 * F.col("n_own") >= F.col("n_all")).select("hash")


def idioms(prints: DataFrame, files: DataFrame, copies: DataFrame, literals: DataFrame, boiler: DataFrame, n_repos: int, min_owners: int) -> DataFrame:
    """Hashes, no literals, that enough repositories have in files outside ``copies`` (repo, file): a quarter of all, or LISTED_SHARE and ``min_owners`` for listed ones. Only keys with as many rows, and the list, come near."""
    rows = prints.count()
    share = max(1e-12, min(1.0, IDIOM_SHARE * n_repos / max(rows, 1)))
    listed = boiler.select(F.col("hash").cast("long").alias("hash"), F.lit(max(LISTED_SHARE * n_repos, float(min_owners))).alias("least"))
    near = heavy_keys(prints, "hash", share).select(F.col("key").alias("hash"), F.lit(IDIOM_SHARE * n_repos).alias("least"))
    near = near.unionByName(listed).where("hash is not null").groupBy("hash").agg(F.min("least").alias("least")).join(literals, "hash", "left_anti")
    own = files.join(near, "hash").join(copies, ["repo", "file"], "left_anti").select("hash", "least", "repo").distinct()
    return own.groupBy("hash", "least").agg(F.count("*").alias("n")).where("n >= least").select("hash")


def head_marks(text: Column) -> Column:
    """Shingles of three masked words of the leading comment: numbers, addresses and file names lose their identity."""
    found = F.regexp_extract_all(F.lower(F.regexp_extract(text, LEADING_COMMENT, 1)), F.lit(HEAD_TOKEN), F.lit(1))
    masked = F.transform(found, lambda t: F.when(t.rlike(r"^\d"), "0").when(t.contains("://"), "u").when(t.rlike(r"\w\.[a-z]"), "f").otherwise(t))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(masked) - WORDS + 1)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(masked, i, F.lit(WORDS)), " ")))
    return F.when(F.size(found) > 0, F.array_distinct(shingles)).otherwise(F.array().cast("array<string>"))


def path_marks(path: Column) -> Column:
    """Directories on the way to the file, and first and last word of a file name of several words, its ending aside."""
    parts = F.split(_slashed(path), "/")
    place = F.slice(parts, F.lit(1), F.size(parts) - 1)
    words = F.filter(F.split(F.element_at(parts, -1), r"[._-]+"), lambda w: w != "")
    many = F.size(words) >= 3
    name = F.when(many, F.array(F.concat(F.lit("b:"), F.get(words, F.lit(0))), F.concat(F.lit("e:"), F.get(words, F.size(words) - 2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(F.filter(place, lambda p: p != ""), lambda p: F.concat(F.lit("d:"), p)), name))


def heads(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, file, marks, squeezed_head, data_head) of the files with a text; names: (repo, name)."""
    stripped = F.regexp_replace("text", r"//[^\n]*|/\*[\s\S]*?\*/|(?m)^#[^\n]*", "")
    literals = F.length(F.regexp_replace(stripped, r"0[xX][0-9a-fA-F]+|\"[^\"\n]*\"|'[^'\n]*'|\d+|[,\s{}]", ""))
    longest = F.array_max(F.transform(F.split("text", "\n"), F.length))
    once = sources.select(F.col("repo").alias("name"), F.col("relpath").alias("file"), "text").where("name is not null and file is not null and text != ''").join(names, "name").groupBy("repo", "file").agg(F.max("text").alias("text"))
    return once.select(
        "repo", "file", head_marks(F.col("text")).alias("marks"), ((longest > 200) & (F.length("text") / F.size(F.split("text", "\n")) > 120)).alias("squeezed_head"),
        ((F.length(F.trim(stripped)) >= 40) & (literals < 0.25 * F.length(stripped))).alias("data_head"),
    )


def learned_marks(bearing: DataFrame, min_owners: int, hints: bool) -> DataFrame:
    """(mark, f, o): marks whose long files are foreign almost without exception, with the number of foreign and of owned files. bearing: (mark, owner, long, foreign, owned)."""
    per_owner = bearing.where("long").groupBy("mark", "owner").agg(F.count("*").alias("n"), F.count_if("foreign").alias("f"), F.count_if("owned").alias("o"))
    stats = per_owner.groupBy("mark").agg(F.count("*").alias("owners"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("o").alias("o"))
    if hints:
        spark = bearing.sparkSession
        known = spark.createDataFrame([(m, kind == "copied") for kind, ms in HINTS.items() for m in ms], "mark string, hinted boolean")
        stats = stats.join(known, "mark", "full").where((F.col("f") >= MARK_RATE * F.col("n")) & ((F.col("owners") >= min_owners) | F.col("hinted").isNotNull()) | F.col("n").isNull())
        return stats.select("mark", F.coalesce("f", F.lit(1)).alias("f"), F.coalesce("o", F.col("hinted").cast("long")).alias("o"))
    return stats.where((F.col("owners") >= min_owners) & (F.col("f") >= MARK_RATE * F.col("n"))).select("mark", "f", "o")


def not_handwritten(prints: DataFrame, sources: DataFrame, repos: DataFrame, boiler: DataFrame, min_owners: int = MIN_OWNERS, hints: bool = False) -> DataFrame:
    """(repo, file, kind): kind is 'data', 'copied', 'squeezed' or 'generated', the first that holds."""
    rows = prints.where("hash is not null and repo is not null and file is not null").select(F.col("repo").cast("long").alias("repo"), "file", F.col("hash").cast("long").alias("hash"), *[c for c in ("line", "pos") if c in prints.columns])
    known = repos.where("id is not null").groupBy(F.col("id").cast("long").alias("repo")).agg(F.max("name").alias("name"), F.max("owner").alias("owner"), F.max("dir").alias("dir"))
    below = F.coalesce(F.regexp_extract(F.regexp_replace("dir", r"\\", "/"), r"^[^/]*/(.*)$", 1), F.lit(""))
    known = known.select("repo", "name", F.coalesce("owner", "name", F.col("repo").cast("string")).alias("owner"), below.alias("below"))
    n_repos = known.count()
    # Repeated rows count once. Rows are spread by file, so that they become distinct, and are counted per hash, in one shuffle.
    once = rows.repartition("repo", "file").distinct()
    counted = materialise(once.groupBy("repo", "file", "hash").agg(F.count("*").alias("k")), "files")
    # The signatures are combined where the rows are read: a file's rows stand together there, while its distinct hashes are spread.
    banded = rows.groupBy("repo", "file").agg(*_mins("hash", "m")).select("repo", "file", *_bands("m"))
    sizes = counted.groupBy("repo", "file").agg(F.sum("k").alias("n"), F.count("*").alias("nd"))
    files = counted.select("repo", "file", "hash")
    signatures = banded.join(sizes, ["repo", "file"]).join(known.select("repo", "owner", "below"), "repo", "left")
    signatures = materialise(signatures.withColumn("owner", F.coalesce("owner", F.col("repo").cast("string"))), "signatures")

    alike = verified(signatures.where("nd >= 8"), files, min_owners, FAMILY)
    owned = materialise(files.join(cluster_hashes(alike, files, min_owners), "hash", "left_semi"), "owned")
    literals = materialise(literal_hashes(counted, signatures, min_owners), "literals")
    n_literal = counted.join(literals, "hash", "left_semi").groupBy("repo", "file").agg(F.sum("k").alias("n_literal"))
    # A library in very many repositories would pass for idioms, so copies have no say in them.
    shares = signatures.select("repo", "file", "nd").join(owned.groupBy("repo", "file").agg(F.count("*").alias("k")), ["repo", "file"])
    copies = shares.where(F.col("k") >= COPIED_SHARE * F.col("nd")).select("repo", "file")
    common = materialise(idioms(rows, files, copies, literals, boiler, n_repos, min_owners), "idioms")

    n_idioms = files.join(common, "hash", "left_semi").groupBy("repo", "file").agg(F.count("*").alias("n_idioms"))
    n_library = owned.join(common, "hash", "left_anti").groupBy("repo", "file").agg(F.count("*").alias("n_library"))
    judged = signatures.select("repo", "file", "n", "nd", "owner", "below")
    for part in (n_idioms, n_library, n_literal, families(alike), heads(sources, known.select("repo", "name"))):
        judged = judged.join(part, ["repo", "file"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_idioms", "n_library", "n_literal")}
    no = {c: F.coalesce(c, F.lit(False)) for c in ("family", "squeezed_head", "data_head")}
    judged = judged.withColumns(zero | no)
    is_owned = (F.col("n_library") > 0) & (F.col("n_library") >= COPIED_SHARE * (F.col("nd") - F.col("n_idioms")))
    judged = judged.withColumns({"bare": F.col("n_idioms") == 0, "owned": is_owned, "places": path_marks(F.col("file"))})
    judged = materialise(judged.withColumn("marks", F.concat(F.coalesce("marks", F.array().cast("array<string>")), "places")).drop("places"), "judged")

    bearing = judged.select("repo", "file", "owner", (F.col("nd") >= LONG).alias("long"), (F.col("bare") | F.col("owned")).alias("foreign"), "owned", "bare", F.explode("marks").alias("mark"))
    marks = materialise(learned_marks(bearing, min_owners, hints), "marks")
    mostly = 2 * F.sum("o") >= F.sum("f")
    marked = bearing.where("bare").join(marks, "mark").groupBy("repo", "file").agg(mostly.alias("library_mark"))
    places = known.where("below != ''").select("repo", F.explode(F.transform(F.split(_slashed(F.col("below")), "/"), lambda p: F.concat(F.lit("d:"), p))).alias("mark")).join(marks, "mark").groupBy("repo").agg(mostly.alias("library_place"))
    bare = F.col("bare")
    kind = (
        F.when((F.col("n_literal") >= BLOB_SHARE * F.col("n")) & (F.col("n_literal") > 0) | F.col("data_head") & bare, "data")
        .when(F.col("owned") | F.col("library_place") | F.col("library_mark"), "copied")
        .when(bare & F.col("squeezed_head"), "squeezed")
        .when(bare & F.col("family") | F.col("library_mark").isNotNull() | F.col("library_place").isNotNull(), "generated")
    )
    return judged.drop("marks").join(marked, ["repo", "file"], "left").join(places, "repo", "left").select("repo", "file", kind.alias("kind")).where("kind is not null")
