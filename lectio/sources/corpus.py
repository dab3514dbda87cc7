"""S1 / S2 corpus ingest: nested corpus JSON -> flat passage table.

Input documents follow the reference's shape
``{version, books: [{bookName, bookShort, testament?, bookNumber?, chapters: [{chapter,
verses: [{verse, text?, title?}]}]}]}``; a path may hold many such files (one document
per file, ``multiLine``), so large corpora split into one file per book or per chapter
and are parsed in parallel. The schema is explicit, never inferred.

Arrival order ``ord`` counts passages from 0: a passage's position in its document plus the
passages of all earlier files (by name, path after path). The counts of files are summed in
two levels, so no width is fixed and no task or window sees all passages or all files."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import reference_label, verse_key
from ..session import scratch_path
from .jsonscan import split_verses

VERSE_T = T.StructType([T.StructField("verse", T.IntegerType()), T.StructField("text", T.StringType()),
                        T.StructField("title", T.StringType())])
CHAPTER_T = T.StructType([T.StructField("chapter", T.IntegerType()),
                          T.StructField("verses", T.ArrayType(VERSE_T))])
BOOK_T = T.StructType([T.StructField("bookName", T.StringType()), T.StructField("bookShort", T.StringType()),
                       T.StructField("testament", T.IntegerType()), T.StructField("bookNumber", T.IntegerType()),
                       T.StructField("chapters", T.ArrayType(CHAPTER_T))])
CORPUS_SCHEMA = T.StructType([T.StructField("version", T.StringType()),
                              T.StructField("books", T.ArrayType(BOOK_T))])

def _bases(files: DataFrame) -> DataFrame:
    """``(__file, __base)``: how many passages the files before each hold, in name order. The
    files are range-partitioned and summed in two levels, so no task sees all of them."""
    spark = files.sparkSession
    path = scratch_path(spark, "corpus-files")
    (files.repartitionByRange("__file").withColumn("__part", F.spark_partition_id())
     .write.mode("overwrite").parquet(path))
    files = spark.read.schema("__file string, __n long, __part int").parquet(path)
    inside = Window.partitionBy("__part").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    parts = files.groupBy("__part").agg(F.sum("__n").alias("__sum"))
    parts = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    files = files.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return files.join(parts, "__part").select("__file", (F.col("__start") + F.col("__in")).alias("__base"))


def _whole_files(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, DataFrame]:
    """``(verses, counts)`` as of ``split_verses``, by Spark's JSON reader: a file is one task."""
    raw = (spark.read.schema(CORPUS_SCHEMA).option("multiLine", multi_line)
           .option("recursiveFileLookup", "true").json(path).withColumn("file", F.input_file_name()))
    # a document's passages in order, numbered inside it; null lists hold nothing
    flat = F.flatten(F.transform(F.filter("books", lambda b: b["chapters"].isNotNull()), lambda b: F.flatten(
        F.transform(F.filter(b["chapters"], lambda c: c["verses"].isNotNull()),
                    lambda c: F.transform(c["verses"], lambda v: F.struct(
                        b["bookName"].alias("bookName"), b["bookShort"].alias("bookShort"),
                        b["testament"].alias("testament"), b["bookNumber"].alias("bookNumber"),
                        c["chapter"].alias("chapter"), v.alias("v")))))))
    sized = raw.select("file", "version", F.coalesce(flat, F.array()).alias("all"))
    verses = sized.select("file", "version", F.posexplode("all").alias("pos", "b")).withColumn("v", F.col("b.v"))
    return verses, sized.groupBy("file").agg(F.sum(F.size("all").cast("long")).alias("n"))


def read_corpus(spark: SparkSession, paths: list[str], default_versions: list[str] | None = None,
                strict: bool = False, multi_line: bool = True, split: bool = False) -> DataFrame:
    """S1 (``strict=False``): version falls back to the path's default, testament and
    bookNumber to 0, text to ""; a book without chapters or a chapter without verses
    contributes nothing. S2 (``strict=True``): no defaults, an absent text is "null".
    A missing path is logged and skipped, as the reference warns and continues.
    ``split``: files are parsed by byte ranges (:mod:`.jsonscan`), for documents too large for a task."""
    default_versions = default_versions or [None] * len(paths)
    out, total = None, 0
    for i, (path, dv) in enumerate(zip(paths, default_versions)):
        try:
            verses, counts = split_verses(spark, path) if split else _whole_files(spark, path, multi_line)
        except AnalysisException as e:
            logging.getLogger(__name__).warning("corpus path %s skipped: %s", path, e)
            continue
        verses = (verses.join(_bases(counts.select(F.col("file").alias("__file"), F.col("n").alias("__n"))), F.col("file") == F.col("__file"))
                  .withColumnRenamed("pos", "__pos"))
        if strict:
            version = F.col("version")
            testament, book_no = F.col("b.testament"), F.col("b.bookNumber")
            text = F.coalesce(F.col("v.text"), F.lit("null"))
        else:
            version = F.coalesce(F.col("version"), F.lit(dv))
            testament = F.coalesce(F.col("b.testament"), F.lit(0))
            book_no = F.coalesce(F.col("b.bookNumber"), F.lit(0))
            text = F.coalesce(F.col("v.text"), F.lit(""))
        flat = verses.select(
            (F.col("__base") + F.col("__pos")).alias("__ord"),
            version.alias("version"), F.col("b.bookShort").alias("book_short"),
            F.col("b.bookName").alias("book_name"), testament.cast("int").alias("testament"),
            book_no.cast("int").alias("book_number"), F.col("b.chapter").alias("chapter"),
            F.col("v.verse").alias("verse"), F.col("v.title").alias("title"), text.alias("text"))
        # a later path begins where the paths before it end
        flat = flat.withColumn("ord", (F.lit(total) + F.col("__ord")).cast("long")).drop("__ord")
        if i + 1 < len(paths):
            total += int(counts.agg(F.sum("n").alias("n")).first()["n"] or 0)
        out = flat if out is None else out.unionByName(flat)
    if out is None:
        out = spark.createDataFrame([], "ord long, version string, book_short string, book_name string, "
                                        "testament int, book_number int, chapter int, verse int, title string, "
                                        "text string")
    return out.withColumn("reference", reference_label()).withColumn("key", verse_key())


#: Conversations of one test document.
CHAPTERS = 5000


def write_conversation_corpus(spark: SparkSession, conversations: DataFrame, path: str) -> str:
    """Test corpus from ``conversations``: book = conv_id % 5, chapter = conv_id,
    verse = turn, one document (file) per book and range of ``CHAPTERS`` conversations. Book 2 has no version (takes the
    default), book 3 no testament, book 4 no bookNumber; turn 0 of conversation 0 has no
    text; an extra sixth document holds a book without chapters."""
    c = conversations.select(
        F.col("conv_id"), F.col("turn"),
        F.when((F.col("conv_id") == 0) & (F.col("turn") == 0), F.lit(None)).otherwise(F.col("text")).alias("text"))
    chapters = (c.groupBy("conv_id")
                .agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("verse"),
                                                          F.col("text").alias("text"),
                                                          F.lit(None).cast("string").alias("title")))).alias("verses"))
                .select((F.col("conv_id") % 5).cast("int").alias("part"),
                        F.struct(F.col("conv_id").cast("int").alias("chapter"), "verses").alias("ch")))
    books = (chapters.withColumn("range", F.floor(F.col("ch.chapter") / CHAPTERS))
             .groupBy("part", "range")
             .agg(F.sort_array(F.collect_list(F.struct(F.col("ch.chapter").alias("k"), F.col("ch").alias("ch"))))
                  .alias("chs"))
             .select("part", "range", F.transform("chs", lambda x: x["ch"]).alias("chapters")))
    p = F.col("part")
    docs = books.select(
        F.format_string("%d-%012d", "part", "range").alias("part"),
        F.when(p == 2, F.lit(None).cast("string")).otherwise(F.lit("CONV")).alias("version"),
        F.array(F.struct(F.concat(F.lit("Conv "), p.cast("string")).alias("bookName"),
                         F.concat(F.lit("c"), p.cast("string")).alias("bookShort"),
                         F.when(p == 3, F.lit(None)).otherwise(p % 2 + 1).cast("int").alias("testament"),
                         F.when(p == 4, F.lit(None)).otherwise(p + 1).cast("int").alias("bookNumber"),
                         F.col("chapters").alias("chapters"))).alias("books"))
    empty = spark.range(1).select(
        F.lit("5-000000000000").alias("part"), F.lit("CONV").alias("version"),
        F.array(F.struct(F.lit("Empty").alias("bookName"), F.lit("e").alias("bookShort"),
                         F.lit(1).alias("testament"), F.lit(9).alias("bookNumber"),
                         F.lit(None).cast(T.ArrayType(CHAPTER_T)).alias("chapters"))).alias("books"))
    docs.unionByName(empty).write.mode("overwrite").partitionBy("part").json(path)
    return path
