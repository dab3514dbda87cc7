"""End-to-end searches over a table of queries.

One run answers every query of the input table. The query side is classified first
(validation, scope, intent), then each query is routed to exactly the branches it needs:
KEYWORD queries never reach the similarity kernel, SEMANTIC queries never scan text.

Shuffles: the k-NN kernel ships at most ``partitions * queries * 50`` candidates to the
final per-query top-k; keyword hits are cut per filter signature by a partial
``WindowGroupLimit`` before their shuffle; everything else joins per-query rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.classify import (Thresholds, centroid_literals, classify_intent, detect_scope,
                                  prototype_centroids, validate_queries)
from ..operators.filters import keyword_join, scope_matches, version_matches, with_version_rules
from ..operators.hydrate import hydrate, written
from ..operators.knn import knn_candidates
from ..operators.rerank import (CANDIDATE_COUNT, CANDIDATE_FLOOR, DEFAULT_MAX_RESULTS, DEFAULT_MIN_SCORE,
                                TIE_DIGITS, query_words, rerank_by_words, top_per_group)
from ..sources.dictionaries import Dictionaries
from ..session import scratch_path
from ..sources.grams import GramIndex

RESULT_COLUMNS = ["qid", "rank", "key", "reference", "book_name", "book_short", "chapter", "verse",
                  "title", "text", "version", "score", "reranked_score"]
VERSE_COLUMNS = ["ord", "key", "reference", "book_name", "book_short", "testament", "chapter", "verse",
                 "title", "text", "version"]
# Beside ``ord``, what tells apart passages that were loaded with one ord
IDENTITY = ["version", "book_short", "verse"]
PART_BYTES = 32 << 20   # bytes of candidates and query words that are broadcast at once
ROW_BYTES = 48          # of a candidate
SIGNATURE = ["search_keyword", "version_filter", "alias_lower", "alias_exact",
             "scope_type", "scope_books", "scope_testament"]


@dataclass
class SearchInputs:
    verses: DataFrame            # VERSE_COLUMNS
    vectors: DataFrame           # ord, embedding
    queries: DataFrame           # qid, query, max_results, min_score, version, qvec
    prototypes: DataFrame        # set, class, vec_id, embedding
    dicts: Dictionaries
    thresholds: Thresholds = field(default_factory=Thresholds)
    candidate_count: int = CANDIDATE_COUNT
    candidate_floor: float = CANDIDATE_FLOOR
    prefilter: bool = False      # filter version/scope before the top-50 cut (not the reference order)
    score_mode: str = "cosine"   # or "relevance": (1 + cos) / 2
    scope_match: str = "reference"  # or "phrase": whole English scope phrase, word-bounded OT/NT
    index: DataFrame | None = None  # the vectors packed by ``sources.vectors.write_index``
    # the passages' gram index, or what gives it to the searches that need one; without it a search builds one
    grams: GramIndex | Callable[[], GramIndex] | None = None
    # adds the vector of a text column: (frame, text column, new column) -> frame. With it the
    # cleaned query has a vector of its own; without it the query's vector stands in.
    embed: Callable[[DataFrame, str, str], DataFrame] | None = None

    def gram_index(self) -> GramIndex | None:
        return self.grams() if callable(self.grams) else self.grams


def query_context(inp: SearchInputs, centroids: dict | None = None) -> DataFrame:
    """Valid queries with scope, intent and request defaults resolved (one row per qid).

    The result is persisted: it is small (one row per query) and read by several
    branches and size checks; a lost block is recomputed from its lineage."""
    c = centroids if centroids is not None else centroid_literals(prototype_centroids(inp.prototypes))
    q = inp.queries
    # classification is CPU-heavy per row: a query log arriving in fewer partitions than
    # the cluster has cores is spread first (a shuffle of the small query side only)
    cores = q.sparkSession.sparkContext.defaultParallelism
    if q.rdd.getNumPartitions() < cores:
        q = q.repartition(cores, "qid")
    q = validate_queries(q).filter("valid")
    q = detect_scope(q, c, inp.dicts, inp.thresholds, scope_match=inp.scope_match)
    # scope is judged on the query's vector; intent and search use that of the cleaned query
    q = inp.embed(q, "search_query", "search_vec") if inp.embed else q.withColumn("search_vec", F.col("qvec"))
    q = classify_intent(q, c, inp.dicts.stop_words, inp.thresholds, text_col="search_query", vec_col="search_vec")
    q = q.drop("error").withColumn("error", F.when(F.col("needs_semantic"), width_error(inp)))
    q = (q.withColumn("k", F.coalesce(F.col("max_results"), F.lit(DEFAULT_MAX_RESULTS)).cast("int"))
         .withColumn("min_score", F.coalesce(F.col("min_score"), F.lit(DEFAULT_MIN_SCORE)).cast("double"))
         .withColumn("version_filter", F.col("version"))
         .withColumn("search_keyword", F.when(is_blank("extracted_keyword"), F.col("search_query"))
                     .otherwise(F.col("extracted_keyword"))))
    return with_version_rules(q, inp.dicts.version_alias, "version_filter").persist()


ERROR_WIDTH = "Vectors must have the same length"


def width_error(inp: SearchInputs, vec_col: str = "search_vec") -> Column:
    """The error of a query whose vector can't be compared with the store's, else null: that query
    fails alone. The store's least and greatest width are one small aggregate."""
    width = F.col("width") if inp.index is not None else F.size("embedding")
    stored = (inp.index if inp.index is not None else inp.vectors.filter("embedding is not null and size(embedding) > 0"))
    ends = stored.agg(F.min(width).alias("lo"), F.max(width).alias("hi")).first()
    own = F.size(vec_col)
    if ends["lo"] is None:
        return F.lit(None).cast("string")
    return F.when(F.col(vec_col).isNotNull() & (own > 0) & ((own != ends["lo"]) | (own != ends["hi"])), F.lit(ERROR_WIDTH))


def _result_projection(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("score", "reranked_score") else F.col(c)
                       for c in [*RESULT_COLUMNS, *more]])


# ---------------------------------------------------------------------------
# Semantic branch (V2 + J1 + R2)
# ---------------------------------------------------------------------------

def semantic_candidates(inp: SearchInputs, ctx: DataFrame) -> DataFrame:
    """Top-50 cosine candidates of each query in ``ctx``, met with their texts (J1), filtered by
    version and scope *after* the cut (R2), re-ranked (R1) and floored at min_score. Rows are narrow
    and written: every text is read and scored once, however many branches follow; what is left
    after the last cut gets its passage columns by ``with_passages``."""
    ctx = ctx.filter(F.col("error").isNull())
    corpus = inp.index if inp.index is not None else inp.vectors
    qside = ctx.select("qid", F.col("search_vec").alias("qvec"))
    if inp.prefilter:
        # each query goes to the versions that it allows (those of the corpus, a small set) and
        # meets only their blocks; attributes sit next to the vectors of an index
        versions = inp.verses.select(F.col("version").alias("allowed_version")).distinct()
        qside = (ctx.select("qid", F.col("search_vec").alias("qvec"), "version_filter", "alias_lower", "alias_exact",
                            "scope_type", "scope_books", "scope_testament")
                 .join(versions, version_matches("allowed_version", "version_filter"))
                 .drop("version_filter", "alias_lower", "alias_exact"))
        if inp.index is None and "version" not in inp.vectors.columns:
            corpus = inp.vectors.join(inp.verses.select("ord", "version", "book_short", "testament"), "ord")
    cands = knn_candidates(corpus, qside, k=inp.candidate_count, min_score=inp.candidate_floor,
                           score_mode=inp.score_mode, prefilter=inp.prefilter)
    small = ctx.select("qid", "intent", query_words("search_query").alias("words"), "search_keyword", "k", "min_score",
                       "version_filter", "alias_lower", "alias_exact", "scope_type", "scope_books", "scope_testament")
    # A text beside each of its candidates would be a corpus many times over. Queries are taken in parts
    # whose candidates and words are broadcast; each part reads the texts and writes narrow rows.
    width = ctx.agg(F.coalesce(F.sum(F.octet_length("search_query") * 4 + inp.candidate_count * ROW_BYTES), F.lit(0))).first()[0]
    parts = max(1, math.ceil(width / PART_BYTES))
    if parts > 1:
        cands = written(cands, "candidates")
    path = scratch_path(cands.sparkSession, "scored")
    for p in range(parts):
        own = F.pmod(F.xxhash64("qid"), F.lit(parts)) == p
        j = (hydrate(cands.filter(own), inp.verses, ["text", "testament", *IDENTITY], few=True)   # J1 (F7: unresolved dropped)
             .join(F.broadcast(small.filter(own)), "qid")
             .filter(version_matches("version", "version_filter") & scope_matches()))
        j = j.select("qid", "ord", *IDENTITY, "score", "cand_rank", "intent", "k", "min_score",
                     rerank_by_words("score", "text", "words").alias("reranked_score"),
                     F.col("text").contains(F.col("search_keyword")).alias("keyword_hit"))
        j.write.mode("append").parquet(path)
    return cands.sparkSession.read.schema(j.schema).parquet(path).filter(F.col("reranked_score") >= F.col("min_score"))


def with_passages(rows: DataFrame, verses: DataFrame) -> DataFrame:
    """``rows`` (ord and ``IDENTITY``) with the wide passage columns, each row its own passage."""
    own = rows.withColumnsRenamed({c: f"__{c}" for c in IDENTITY})
    met = hydrate(own, verses, VERSE_COLUMNS)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in IDENTITY]
    return met.filter(reduce(Column.__and__, same)).drop(*(f"__{c}" for c in IDENTITY))


def _top_semantic(cands: DataFrame) -> DataFrame:
    order = [F.round("reranked_score", TIE_DIGITS).desc(), F.col("cand_rank").asc()]
    return top_per_group(cands, "qid", order, F.col("k"))


# ---------------------------------------------------------------------------
# Keyword branch (F1 + F2 + F3 + W2 via J7)
# ---------------------------------------------------------------------------

def keyword_hits(inp: SearchInputs, ctx: DataFrame, k_col: str = "k") -> DataFrame:
    """First-k keyword hits per query in arrival order, after version and scope filters.

    Queries sharing a filter signature (keyword, version rule, scope) share one cut. The
    text scan (J7) carries only the narrow filter columns; the ``row_number <= kmax`` cut
    is planned as a partial ``WindowGroupLimit`` before its shuffle, so a keyword that
    matches a third of the corpus still ships at most kmax rows per map partition. Rows are
    narrow; ``with_passages`` adds the wide passage columns."""
    ctx = ctx.filter(F.col("error").isNull())
    sig = (ctx.select(*SIGNATURE, F.col(k_col).alias("k"))
           .groupBy(*SIGNATURE).agg(F.max("k").alias("sig_k"))
           .withColumn("sig_id", F.struct(*SIGNATURE)))
    kmax = max(int(sig.agg(F.max("sig_k").alias("kmax")).first()["kmax"] or 0), 1)
    narrow = ["ord", "version", "book_short", "testament"]
    pairs = keyword_join(inp.verses, sig.select(F.col("search_keyword").alias("keyword")), carry=narrow, index=inp.gram_index(), first=kmax)
    # a keyword may match a third of the corpus: Spark broadcasts the signatures while
    # they are small in bytes; beyond that AQE splits the skewed join
    hits = pairs.join(sig, F.col("keyword") == F.col("search_keyword")).drop("keyword")
    hits = hits.filter(version_matches("version", "version_filter") & scope_matches())
    hits = top_per_group(hits.select("sig_id", "sig_k", "ord"), "sig_id", [F.col("ord").asc()], kmax, "sig_rank") \
        .filter(F.col("sig_rank") <= F.col("sig_k"))
    per_q = ctx.select("qid", "intent", F.col(k_col).alias("k"), F.struct(*SIGNATURE).alias("sig_id"))
    out = hits.join(per_q, "sig_id").filter(F.col("sig_rank") <= F.col("k")).drop("sig_id", "sig_k")
    out = hydrate(out, inp.verses, IDENTITY)
    return (out.withColumn("rank", F.col("sig_rank")).withColumn("score", F.lit(1.0))
            .withColumn("reranked_score", F.lit(1.0)))


# ---------------------------------------------------------------------------
# Public searches
# ---------------------------------------------------------------------------

def keyword_search(inp: SearchInputs, ctx: DataFrame | None = None) -> DataFrame:
    """Every valid query as a keyword search (keyword = extracted or search query)."""
    ctx = ctx if ctx is not None else query_context(inp)
    return _result_projection(with_passages(keyword_hits(inp, ctx), inp.verses))


def semantic_search(inp: SearchInputs, ctx: DataFrame | None = None) -> DataFrame:
    """E2 (flagship): every valid query as a two-stage semantic search."""
    ctx = ctx if ctx is not None else query_context(inp)
    return _result_projection(with_passages(_top_semantic(semantic_candidates(inp, ctx)), inp.verses))


def not_keyword_hits(cands: DataFrame) -> DataFrame:
    """Semantic candidates that the keyword branch does not already give."""
    return cands.filter(~F.col("keyword_hit"))


def _hybrid_merge(kw: DataFrame, sem: DataFrame) -> DataFrame:
    """Keyword rows first (arrival order), then re-ranked semantic rows that are
    not keyword hits (J4), into the slots left by max_results."""
    kw = kw.select("qid", "ord", *IDENTITY, "score", "reranked_score", "k",
                   F.lit(0).alias("prio"), F.lit(0.0).alias("sk1"), F.col("ord").alias("sk2"))
    sem = not_keyword_hits(sem).select(
        "qid", "ord", *IDENTITY, "score", "reranked_score", "k",
        F.lit(1).alias("prio"), (-F.round("reranked_score", TIE_DIGITS)).alias("sk1"),
        F.col("cand_rank").cast("long").alias("sk2"))
    return top_per_group(kw.unionByName(sem), "qid", [F.col("prio"), F.col("sk1"), F.col("sk2")], F.col("k"))


def hybrid_search(inp: SearchInputs, ctx: DataFrame | None = None) -> DataFrame:
    """Every valid query as a hybrid search."""
    ctx = ctx if ctx is not None else query_context(inp)
    merged = _hybrid_merge(keyword_hits(inp, ctx), semantic_candidates(inp, ctx))
    return _result_projection(with_passages(merged, inp.verses))


def routed_search(inp: SearchInputs, ctx: DataFrame | None = None) -> DataFrame:
    """Scope -> intent -> exactly one branch per query; adds ``search_method``.

    One similarity scan serves every SEMANTIC and HYBRID query and one text scan every
    KEYWORD and HYBRID query; KEYWORD queries never reach the vector kernel."""
    ctx = ctx if ctx is not None else query_context(inp)
    cands = semantic_candidates(inp, ctx.filter("needs_semantic"))
    hits = keyword_hits(inp, ctx.filter("needs_keyword"))
    sem = _top_semantic(cands.filter(F.col("intent") == "SEMANTIC"))
    kw = hits.filter(F.col("intent") == "KEYWORD")
    hyb = _hybrid_merge(hits.filter(F.col("intent") == "HYBRID"), cands.filter(F.col("intent") == "HYBRID"))
    parts = [df.select("qid", "rank", "ord", *IDENTITY, "score", "reranked_score", F.lit(m).alias("search_method"))
             for m, df in (("KEYWORD", kw), ("SEMANTIC", sem), ("HYBRID", hyb))]
    found = with_passages(parts[0].unionByName(parts[1]).unionByName(parts[2]), inp.verses)
    return _result_projection(found, "search_method")


def response_envelope(inp: SearchInputs, results: DataFrame | None = None, ctx: DataFrame | None = None,
                      nested: bool = False) -> DataFrame:
    """One row per input query with the response fields. Invalid queries and ones that
    fail alone (a vector of another width) are rows without success, beside the others' answers;
    results are summarised as ``total_results`` and ``result_keys`` (keys in rank order). ``nested``: ``context_books`` is an
    array, else a comma-joined string."""
    ctx = ctx if ctx is not None else query_context(inp)
    results = results if results is not None else routed_search(inp, ctx)
    agg = (results.groupBy("qid")
           .agg(F.count(F.lit(1)).cast("int").alias("total_results"),
                F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("__r"))
           .select("qid", "total_results", F.array_join(F.transform("__r", lambda r: r["key"]), ",").alias("result_keys")))
    has_ctx = F.col("scope_type") != "NONE"
    failed = ctx.filter(F.col("error").isNotNull()).select("qid", F.col("error").alias("failure"))
    info = ctx.filter(F.col("error").isNull()).select(
        "qid", F.col("intent").alias("search_method"), "extracted_keyword", "intent_reason",
        F.when(has_ctx, F.col("scope_type")).alias("detected_context_type"),
        F.when(has_ctx, F.col("scope_desc")).alias("detected_context"),
        F.when(has_ctx, F.col("scope_books")).alias("__books"), "search_query")
    v = validate_queries(inp.queries.select("qid", "query"))
    out = v.join(info, "qid", "left").join(agg, "qid", "left").join(failed, "qid", "left")
    return out.select(
        "qid", F.when(F.col("valid"), F.col("query")).alias("query"),
        (F.col("valid") & F.col("failure").isNull()).alias("success"), F.coalesce("error", "failure").alias("error"),
        F.coalesce("total_results", F.lit(0)).cast("int").alias("total_results"),
        "search_method", "extracted_keyword", "intent_reason", "detected_context_type", "detected_context",
        F.col("__books").alias("context_books") if nested else F.array_join("__books", ",").alias("context_books"), "search_query", "result_keys")


def nested_responses(envelope: DataFrame, results: DataFrame) -> DataFrame:
    """E9 nested form: one row per query with ``results`` as an array of result structs
    in rank order (each query's list is at most max_results long)."""
    cols = [c for c in RESULT_COLUMNS if c != "qid"]
    lists = (results.groupBy("qid")
             .agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("results")))
    return (envelope.join(lists, "qid", "left")
            .withColumn("results", F.coalesce("results", F.array().cast(lists.schema["results"].dataType))))


def write_responses(responses: DataFrame, uri: str, run_id: str, fmt: str = "json") -> str:
    """S10 result sink: responses of one run under ``uri/run=<run_id>``; rewriting a run
    replaces only that run's folder (dynamic partition overwrite)."""
    (responses.withColumn("run", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").format(fmt).save(uri))
    return uri
