"""Readers for the supplied Parquet tables and the views that shape them into the
engine's data model (passages, queries, vectors, prototypes).

All readers return lazy DataFrames; column pruning and filters reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import reference_label, verse_key

CHAPTER_SIZE = 200          # documents per synthetic chapter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage table built from ``documents``.

    Columns: ord, version, book_short, book_name, testament, book_number, chapter, verse,
    title, text, reference, key. ``ord`` is arrival order. The verse-number window is
    partitioned by (lang, source, chapter), so no window partition exceeds one chapter. The texts
    are shuffled once, by ranges of chapters; that holds each window together, and as chapters are
    runs of ``ord``, it is the layout by ``ord`` as well."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    book_no = F.substring("source", 4, 1 << 30).cast("int")
    chap0 = F.floor(F.col("doc_id") / F.lit(float(CHAPTER_SIZE)))
    w = Window.partitionBy("lang", "source", "chap0").orderBy("doc_id")
    v = (d.withColumn("chap0", chap0).repartitionByRange("chap0")
         .withColumn("verse", F.row_number().over(w).cast("int"))
         .select(
             F.col("doc_id").alias("ord"),
             F.upper("lang").alias("version"),
             F.col("source").alias("book_short"),
             F.concat(F.lit("Book "), F.substring("source", 4, 1 << 30)).alias("book_name"),
             F.when(book_no < 10, 1).otherwise(2).cast("int").alias("testament"),
             (book_no + 1).cast("int").alias("book_number"),
             (F.col("chap0").cast("int") + 1).alias("chapter"),
             "verse",
             F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("title"),
             "text"))
    return v.withColumn("reference", reference_label()).withColumn("key", verse_key())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector store ``(ord, embedding)``: the supplied embeddings keyed by passage ord."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query log built from ``benchmark``: one query shape per item (see FIXTURES.md).

    Columns: qid, query, max_results, min_score, version (request fields; null means the
    service default)."""
    # three words of the whole text: the longest, the first and the last in code-point order
    words = F.split("text", " ")
    b = table(spark, sf_dir, "benchmark").select(
        "item_id", "text",
        F.array_max(F.transform(words, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"].alias("w1"),
        F.array_min(words).alias("w2"), F.array_max(words).alias("w3"))
    shape = F.col("item_id") % 16
    book = F.concat(F.lit("book"), F.char(F.lit(97) + F.col("item_id") % 20))
    q = (F.when(shape == 0, F.concat(F.lit('"'), "w1", F.lit('" appears')))
         .when(shape == 1, F.concat(F.lit("documents containing "), "w2"))
         .when(shape == 2, F.concat(F.lit("in src3 about "), "w1", F.lit(" "), "w2"))
         .when(shape == 3, F.substring("w1", 1, 6))
         .when(shape == 4, F.concat(F.lit("from grpa on "), "w2", F.lit(" "), "w3"))
         .when(shape == 5, F.concat("w1", F.lit("라는 단어")))
         .when(shape == 6, F.concat("w1", F.lit(" "), "w2", F.lit(" "), "w3"))
         .when(shape == 8, F.col("text"))
         .when(shape == 9, F.concat(F.lit("in OT about "), "w1", F.lit(" "), "w2"))
         .when(shape == 10, F.concat(F.lit("in src1,src2 about "), "w1"))
         .when(shape == 11, F.concat(book, F.lit(" 3:16")))
         .when(shape == 12, F.concat(book, F.lit(" 99999999999")))
         .when(shape == 13, F.concat(F.lit("src3에서 "), "w1", F.lit(" "), "w2"))
         .when(shape == 14, F.concat(F.lit("from src4 on "), "text"))
         .otherwise(F.lit("  ")))
    return b.select(
        F.col("item_id").alias("qid"), q.alias("query"),
        F.when(F.col("item_id") % 5 == 2, F.lit(3)).cast("int").alias("max_results"),
        F.when(F.col("item_id") % 11 == 4, F.lit(0.15)).cast("double").alias("min_score"),
        # an alias, a version in the other case and a version that no passage has
        F.when(F.col("item_id") % 7 == 3, F.lit("english")).when(F.col("item_id") % 7 == 5, F.lit("fr"))
         .when(F.col("item_id") % 7 == 6, F.lit("Latin")).cast("string").alias("version"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied query vectors ``(qid, qvec)``: the embedding whose vec_id equals the qid."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def queries_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).join(query_vectors(spark, sf_dir), "qid", "left")


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prototype vectors ``(set, class, vec_id, embedding)``.

    Fixture rule (FIXTURES.md): intent prototypes are the vectors with vec_id % 10 = 0
    (label < 5 -> KEYWORD else SEMANTIC); scope prototypes are vec_id % 10 = 1
    (label < 5 -> CONTEXT else NO_CONTEXT)."""
    e = table(spark, sf_dir, "embeddings")
    r = F.col("vec_id") % 10
    low = F.col("label") < 5
    return (e.filter(r.isin(0, 1))
            .select(F.when(r == 0, "intent").otherwise("scope").alias("set"),
                    F.when(r == 0, F.when(low, "KEYWORD").otherwise("SEMANTIC"))
                     .otherwise(F.when(low, "CONTEXT").otherwise("NO_CONTEXT")).alias("class"),
                    "vec_id", "embedding"))
