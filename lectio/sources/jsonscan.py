"""S1 for large files: one corpus document parsed by many tasks.

Spark's multi-line JSON reader gives a whole file to one task. Here the text reader cuts each file
at ``{`` (its ``lineSep``), so a file is read by byte ranges, a range by one task. Whether a piece
begins inside a string, how deep it lies and which book, chapter and verse it belongs to depend on
all that stands before it. Each range sums up what it does to that state (the parity of its quotes,
its net depth, the last object opened at each depth); the sums of a file's ranges, few rows, are
composed in order, and each piece adds what its own range did before it.

Two passes read the text (quotes; then everything else, written to the shared folder), one shuffle
deals pieces by range, one joins the pieces of an object. No group is larger than a range or an
object's own fields: the commas between the children of a book are dropped first.

Documents have the shape of :mod:`.corpus`: objects stand in the lists ``books``, ``chapters`` and
``verses`` alone (other fields may hold numbers, strings and lists of these). Anything else ends in
an error that names the multi-line reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: What stands before a document counts as depth 1.
DOCUMENT, BOOK, CHAPTER, VERSE = 2, 3, 4, 5
CHILDREN = {DOCUMENT: "books", BOOK: "chapters", CHAPTER: "verses"}
FIELDS = {DOCUMENT: "version string", BOOK: "bookName string, bookShort string, testament int, bookNumber int",
          CHAPTER: "chapter int", VERSE: "verse int, text string, title string"}
#: Depths of objects as seen from the depth at which a range begins (0 to VERSE).
RELATIVE = range(DOCUMENT - VERSE, VERSE + 1)
REFUSED = "objects outside books, chapters and verses: read the file with split=False"


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _escaped(text: Column) -> Column:
    """Escaped backslashes and quotes as ``\\u`` escapes, so each quote left begins or ends a string."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))


def _masked(text: Column, inside: Column) -> Column:
    """Brackets inside strings as ``\\u`` escapes; ``inside``: 1 if the text begins in a string."""
    def string(p: Column) -> Column:
        for sign in "}[]":
            p = F.replace(p, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
        return p
    pieces = F.transform(F.split(text, '"', -1), lambda p, i: F.when((i + inside) % 2 == 1, string(p)).otherwise(p))
    # the { that cut the text belongs to the string
    return F.concat(F.when(inside == 1, F.lit("\\u007b")).otherwise(F.lit("")), F.array_join(pieces, '"'))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of every file with its place, its depth in its range and the range's last objects."""
    text = (spark.read.option("lineSep", "{").option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
                    F.monotonically_increasing_id().alias("at"), _escaped(F.col("value")).alias("s")))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = text.groupBy("file", "range").agg(F.sum(_count(F.col("s"), '"')).alias("quotes"), F.count(F.lit(1)).alias("n"))
    starts = sums.select("file", "range", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("odd"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    here = Window.partitionBy("file", "range").orderBy("at")
    before, so_far = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    p = text.join(starts, ["file", "range"]).withColumn("quotes", _count(F.col("s"), '"'))
    p = (p.withColumn("inside", (F.col("odd") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2)
         .withColumn("pos", F.col("first") + F.row_number().over(here))
         .withColumn("s", _masked(F.col("s"), F.col("inside")))
         .withColumn("net", 1 - F.col("inside") - _count(F.col("s"), "}"))
         .withColumn("depth", F.coalesce(F.sum("net").over(before), F.lit(0)) + 1 - F.col("inside")))
    opened = [F.when((F.col("inside") == 0) & (F.col("depth") == r), F.col("pos")) for r in RELATIVE]
    return p.select("file", "range", "pos", "s", "inside", "net", "depth",
                    ((F.col("inside") + F.col("quotes")) % 2).alias("unfinished"),
                    F.array(*(F.last(o, ignorenulls=True).over(so_far) for o in opened)).alias("last"))


def _segments(pieces: DataFrame) -> DataFrame:
    """Pieces cut at ``}``: each segment with its depth and the objects around it."""
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("file", "range").agg(F.sum("net").alias("net"), F.max_by("last", "pos").alias("last"))
    starts = sums.withColumn("start", F.coalesce(F.sum("net").over(earlier), F.lit(0)))

    def at(k: int) -> Column:
        return F.get("last", (F.lit(k - RELATIVE[0]) - F.col("start")).cast("int"))

    levels = range(DOCUMENT, VERSE + 1)
    starts = starts.select("file", "range", "start", *(F.last(at(k), ignorenulls=True).over(earlier).alias(f"before{k}") for k in levels))
    p = pieces.join(starts, ["file", "range"])
    p = p.select("file", "range", "pos", "inside", "unfinished", (F.col("start") + F.col("depth")).alias("top"),
                 *(F.coalesce(at(k), F.col(f"before{k}")).alias(f"in{k}") for k in levels),
                 F.size(F.split("s", r"\}", -1)).alias("n"), F.posexplode(F.split("s", r"\}", -1)).alias("i", "t"))
    p = p.withColumn("level", (F.col("top") - F.col("i")).cast("int")).filter(F.col("level") >= DOCUMENT)
    # a segment that another object follows ends in a comma or opens the list of its level
    opens = (F.col("i") == F.col("n") - 1) & (F.col("unfinished") == 0)
    child = F.lit(False)
    for level, name in CHILDREN.items():
        child = child | ((F.col("level") == level) & F.col("t").rlike(rf'(?:,|"{name}"\s*:\s*\[)\s*$'))
    follows = (F.col("i") == 0) & (F.col("inside") == 1)
    t = F.when(follows, F.col("t")).otherwise(F.regexp_replace("t", r"^\s*(?:\]\s*)?,?\s*", ""))
    t = F.when(opens, F.regexp_replace(t, rf'(?:,\s*)?(?:"(?:{"|".join(CHILDREN.values())})"\s*:\s*\[)?\s*$', "")).otherwise(t)
    t = F.when((F.col("level") > VERSE) | (opens & ~child), F.raise_error(F.lit(REFUSED)).cast("string")).otherwise(t)
    return p.select("file", "range", "pos", "i", "level", F.array(*(f"in{k}" for k in levels)).alias("around"),
                    ((F.col("i") == 0) & (F.col("inside") == 0)).alias("begins"), follows.alias("follows"), t.alias("t"))


def _objects(segments: DataFrame) -> DataFrame:
    """One row per object: its scalar fields as JSON, where it begins and what it lies in."""
    s = segments.filter((F.col("t") != "") | F.col("begins")).withColumn("id", F.get("around", F.col("level") - DOCUMENT))
    joined = s.groupBy("file", "level", "id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "i", "follows", "t"))).alias("parts"),
        F.max(F.when(F.col("begins"), F.struct("range", "around"))).alias("b"))
    fields = F.transform(F.filter("parts", lambda x: x["t"] != ""), lambda x: F.concat(F.when(x["follows"], "").otherwise(","), x["t"]))
    body = F.concat(F.lit("{"), F.regexp_replace(F.array_join(fields, ""), "^,", ""), F.lit("}"))
    return joined.select("file", "level", "id", "b.range", "b.around", body.alias("json"))


def split_verses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(verses, counts)``: ``file, pos`` (place in the file, from 0), ``version``, ``b`` and ``v`` of
    each verse, and ``file, n``. A missing path raises ``AnalysisException``, as Spark's readers do."""
    pieces_at, objects_at = scratch_path(spark, "json-pieces"), scratch_path(spark, "json-objects")
    _pieces(spark, path).write.parquet(pieces_at)
    _objects(_segments(spark.read.parquet(pieces_at))).write.partitionBy("level").parquet(objects_at)
    objects = spark.read.schema("file string, id long, range long, around array<long>, json string, level int").parquet(objects_at)

    def level(k: int) -> DataFrame:
        inner = F.from_json("json", FIELDS[k]).alias("f")
        return objects.filter(F.col("level") == k).select("file", "range", F.col("id").alias(f"id{k}"), F.get("around", F.lit(k - 1 - DOCUMENT)).alias("up"), inner)

    def under(child: DataFrame, k: int, parent: DataFrame, *keep: str) -> DataFrame:
        p = parent.select(F.col("file").alias("pfile"), F.col(f"id{k}").alias("pid"), *keep)
        return child.join(p, (F.col("file") == F.col("pfile")) & (F.col("up") == F.col("pid"))).drop("pfile", "pid", "up")

    # fields go down level by level, so the many verses meet only their chapters
    docs = level(DOCUMENT).withColumn("version", F.col("f.version"))
    books = under(level(BOOK), DOCUMENT, docs, "version").withColumn("book", F.col("f"))
    chapters = under(level(CHAPTER), BOOK, books, "version", "book").withColumn("chapter", F.col("f.chapter"))
    verses = under(level(VERSE), CHAPTER, chapters, "version", "book", "chapter")
    sums = verses.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("file", "range").orderBy(f"id{VERSE}")) - 1
    verses = verses.join(starts, ["file", "range"]).select(
        "file", (F.col("first") + number).alias("pos"), "version", F.struct("book.*", "chapter").alias("b"), F.col("f").alias("v"))
    return verses, sums.groupBy("file").agg(F.sum("n").alias("n"))
