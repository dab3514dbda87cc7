"""Corpus jobs around search: statistics, book info, chapter reading, parallel reading
of two versions, chapter navigation, union and dedup (A1-A3, E5-E8, J5, J6, U2, U3, W4, W5).

All take the passage table (``ord, version, book_short, book_name, testament, chapter,
verse, title, text, reference, key``) and run as grouped aggregates or equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import displayed_score, embedding_text, score_band, score_percent
from ..operators.filters import chapter_predicate_col, chapter_version


# ---------------------------------------------------------------------------
# A1 / A2 statistics
# ---------------------------------------------------------------------------

def corpus_stats(verses: DataFrame, first: str = "KRV", second: str = "ASV") -> DataFrame:
    """A1: total passages and exact-label counts of the two service versions."""
    return verses.agg(F.count(F.lit(1)).alias("total_verses"),
                      F.count_if(F.col("version") == first).alias("krv_verses"),
                      F.count_if(F.col("version") == second).alias("asv_verses"))


def load_counts(verses: DataFrame) -> DataFrame:
    """A2: books and passages per version (partial aggregation before the shuffle)."""
    return verses.groupBy("version").agg(F.countDistinct("book_short").alias("books"),
                                         F.count(F.lit(1)).alias("verses"))


# ---------------------------------------------------------------------------
# A3 / E6 book info, E5 read chapter, W5 neighbours
# ---------------------------------------------------------------------------

def version_requests(verses: DataFrame) -> DataFrame:
    """Reader requests derived from the corpus: each book with each of its version names
    (lower-cased, so the ignore-case rule is exercised) and each book with no version."""
    with_v = verses.select(F.col("book_short").alias("req_book"), F.lower("version").alias("req_version"))
    no_v = verses.select(F.col("book_short").alias("req_book"), F.lit(None).cast("string").alias("req_version"))
    return with_v.unionByName(no_v).distinct()


def book_info(verses: DataFrame, requests: DataFrame) -> DataFrame:
    """A3: per request (req_book, req_version): name, code and version of the first
    passage in arrival order and totalChapters = max(chapter); no row when empty.
    Passages are pre-aggregated per (book, version) before meeting the requests."""
    per = (verses.groupBy("book_short", "version")
           .agg(F.min_by(F.struct("book_name", "book_short", "version"), F.col("ord")).alias("first"),
                F.min("ord").alias("first_ord"), F.max("chapter").alias("max_chapter")))
    rv = F.col("req_version")
    vok = (rv.isNull() | (rv == "") | (F.lower(F.col("version")) == F.lower(rv))
           | ((F.lower(rv) == "krv") & (F.col("version") == "개역개정")))
    j = requests.join(per, (F.lower(F.col("book_short")) == F.lower(F.col("req_book"))) & vok)
    return (j.groupBy("req_book", "req_version")
            .agg(F.min_by(F.col("first"), F.col("first_ord")).alias("f"),
                 F.max("max_chapter").alias("total_chapters"))
            .select("req_book", "req_version", F.col("f.book_name").alias("book_name"),
                    F.col("f.book_short").alias("book_short"), F.col("f.version").alias("version"),
                    F.col("total_chapters").cast("int").alias("total_chapters")))


def read_chapter(verses: DataFrame, requests: DataFrame) -> DataFrame:
    """The verses of each requested (req_book, req_chapter, req_version),
    with totalChapters of the book under the same version rule. The reference returns the
    list sorted by verse; here ``verse`` (then ``ord``) is the order key, so no window has
    to hold a whole chapter."""
    hits = verses.join(requests, chapter_predicate_col())
    info = book_info(verses, requests.select("req_book", "req_version").distinct()) \
        .select(F.col("req_book").alias("__book"), F.col("req_version").alias("__version"), "total_chapters")
    return (hits.join(info, F.col("req_book").eqNullSafe(F.col("__book")) & F.col("req_version").eqNullSafe(F.col("__version")), "left")
            .select("req_book", "req_chapter", "req_version", "ord", "reference", "book_name", "book_short",
                    "chapter", "verse", "title", "text", "version",
                    F.coalesce("total_chapters", F.lit(0)).cast("int").alias("total_chapters")))


NOT_FOUND = "Not found"


def chapter_responses(verses: DataFrame, requests: DataFrame) -> DataFrame:
    """E5 as answers: per distinct request ``found``, ``error``, the book's name and the version of
    its first verse, ``total_chapters`` and ``n_verses``, with a row per verse: its ``position`` (W4,
    from 0 by verse, then ord), ``verse`` and ``ord``. A request that nothing meets is one row with
    ``error``, beside the answers of the others. The verses of one request are one window; a
    chapter's rows are narrow there (no text)."""
    asked = ["req_book", "req_chapter", "req_version"]
    requests = requests.select(*asked).distinct()
    hits = read_chapter(verses, requests).select(*asked, "ord", "verse", "book_name", "version", "total_chapters")
    one = Window.partitionBy(*asked)
    place = F.row_number().over(one.orderBy("verse", "ord")) - 1
    hits = hits.select(*asked, "ord", "verse", "total_chapters", place.cast("int").alias("position"), F.count(F.lit(1)).over(one).alias("n"),
                       F.min_by(F.struct("book_name", "version"), F.struct("verse", "ord")).over(one).alias("head"))
    hits = hits.toDF(*(f"__{c}" for c in hits.columns))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in asked]
    found = F.col("__ord").isNotNull()
    return requests.join(hits, same, "left").select(
        *asked, found.alias("found"), F.when(~found, F.lit(NOT_FOUND)).alias("error"), F.col("__head.book_name").alias("book_name"),
        F.col("__head.version").alias("version"), F.col("__total_chapters").alias("total_chapters"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_verses"), F.coalesce("__position", F.lit(0)).alias("position"),
        F.col("__verse").alias("verse"), F.col("__ord").alias("ord"))


def book_info_responses(verses: DataFrame, requests: DataFrame) -> DataFrame:
    """E6 as answers: a request for an unknown book, or one without the version, is an error row."""
    requests = requests.select("req_book", "req_version").distinct()
    info = book_info(verses, requests)
    info = info.withColumnsRenamed({"req_book": "__book", "req_version": "__version"})
    found = F.col("book_short").isNotNull()
    return (requests.join(info, F.col("req_book").eqNullSafe(F.col("__book")) & F.col("req_version").eqNullSafe(F.col("__version")), "left")
            .select("req_book", "req_version", found.alias("found"), F.when(~found, F.lit(NOT_FOUND)).alias("error"),
                    "book_name", "book_short", "version", "total_chapters"))


def chapter_neighbors(verses: DataFrame) -> DataFrame:
    """Previous / next chapter per (version, book), clamped to existing chapters."""
    ch = verses.select("version", "book_short", "chapter").distinct()
    w = Window.partitionBy("version", "book_short").orderBy("chapter")
    return ch.select("version", "book_short", "chapter",
                     F.lag("chapter").over(w).alias("prev_chapter"),
                     F.lead("chapter").over(w).alias("next_chapter"))


# ---------------------------------------------------------------------------
# J6 crosswalk, J5 / E7 parallel reader, E8 hits in context
# ---------------------------------------------------------------------------

def code_pairs(codes: DataFrame, crosswalk: DataFrame, code_col: str = "code") -> DataFrame:
    """The (code_a, code_b) pair a reader opens for a code: a code known on the A
    side maps forward, a code known on the B side maps back, anything else is identity."""
    cw = F.broadcast(crosswalk)
    fwd = cw.select(F.col("code_a").alias("__fa"), F.col("code_b").alias("__fb"))
    back = cw.select(F.col("code_b").alias("__bb"), F.col("code_a").alias("__ba"))
    j = codes.join(fwd, F.col(code_col) == F.col("__fa"), "left").join(back, F.col(code_col) == F.col("__bb"), "left")
    code_a = F.when(F.col("__fa").isNotNull(), F.col(code_col)).otherwise(F.coalesce("__ba", F.col(code_col)))
    code_b = F.when(F.col("__bb").isNotNull(), F.col(code_col)).otherwise(F.coalesce("__fb", F.col(code_col)))
    return j.select(*codes.columns, code_a.alias("code_a"), code_b.alias("code_b"))


def parallel_chapters(verses: DataFrame, crosswalk: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """Every chapter of every book pair, version A beside version B, aligned by
    verse number with a full outer join (a verse missing on one side stays, with null
    text there). totalChapters is the larger of the two books."""
    codes = verses.select(F.col("book_short").alias("code")).distinct()
    pairs = code_pairs(codes, crosswalk).select("code_a", "code_b").distinct()
    a = (verses.filter(chapter_version("version", F.lit(version_a)))
         .select(F.col("book_short").alias("code_a"), "chapter", "verse", F.col("text").alias("text_a")))
    b = (verses.filter(chapter_version("version", F.lit(version_b)))
         .select(F.col("book_short").alias("code_b"), "chapter", "verse", F.col("text").alias("text_b")))
    a = a.join(pairs, "code_a")
    b = b.join(pairs, "code_b")
    tot_a = a.groupBy("code_a").agg(F.max("chapter").alias("ta"))
    tot_b = b.groupBy("code_b").agg(F.max("chapter").alias("tb"))
    j = a.join(b, ["code_a", "code_b", "chapter", "verse"], "full_outer")
    return (j.join(tot_a, "code_a", "left").join(tot_b, "code_b", "left")
            .select("code_a", "code_b", "chapter", "verse", "text_a", "text_b",
                    F.greatest(F.coalesce("ta", F.lit(0)), F.coalesce("tb", F.lit(0))).cast("int")
                    .alias("total_chapters")))


def hits_in_context(results: DataFrame, parallel: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Open the parallel reader at each hit's chapter and flag the hit's verse."""
    hits = code_pairs(results.select("qid", "rank", F.col("book_short").alias("code"), "chapter",
                                     F.col("verse").alias("hit_verse")), crosswalk)
    return (hits.join(parallel, ["code_a", "code_b", "chapter"])
            .select("qid", "rank", "code_a", "code_b", "chapter", "verse",
                    (F.col("verse") == F.col("hit_verse")).alias("highlight")))


# ---------------------------------------------------------------------------
# U2 union, U3 dedup, P1-P3, P6
# ---------------------------------------------------------------------------

def corpus_union(parts: list[DataFrame]) -> DataFrame:
    """Ordered union; the part ordinal leads arrival order (``part``, then ``ord``)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def dedup_last(df: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """Last write wins per key (the reference's map keeps the last row). A grouped
    ``max_by`` rather than a window: each map task folds its copies of a key into one row
    before the shuffle, so a key holding a third of all rows costs one row per task."""
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("__w"))
            .select(key, *[F.col(f"__w.{c}").alias(c) for c in others]))


def passage_texts(verses: DataFrame) -> DataFrame:
    """Embedding text, key and reference label of every passage."""
    return verses.select("ord", "key", "reference", embedding_text().alias("embedding_text"))


def with_score_band(results: DataFrame) -> DataFrame:
    """The displayed score, its band and its percent."""
    d = displayed_score()
    return results.select("qid", "rank", F.round(d, 6).alias("shown_score"), score_band(d).alias("band"),
                          score_percent(d).alias("percent"))


def text_key_map(passages: DataFrame) -> DataFrame:
    """U3, text form: ``(digest, key, ord)``, the passage that a stored segment's embedding text
    resolves to; of equal texts the last one loaded wins. Texts are named by their SHA-256, so none
    is shuffled, and the grouped ``max_by`` is combined map-side."""
    rows = passage_texts(passages).select(F.sha2("embedding_text", 256).alias("digest"), "key", "ord")
    last = rows.groupBy("digest").agg(F.max_by(F.struct("key", "ord"), "ord").alias("last"))
    return last.select("digest", "last.key", "last.ord")
