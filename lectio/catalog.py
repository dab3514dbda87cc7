"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions.text import java_trim, query_tokens
from .functions.vector import norm as vector_norm
from .operators import classify as C
from .operators.filters import keyword_filter, keyword_join, scope_matches, version_matches, with_version_rules
from .operators.hydrate import hydrate
from .operators.knn import cosine_pairs as _cosine_pairs, knn_candidates
from .operators.rerank import rerank_score, top_per_group
from .plans import reader as R
from .plans import search as S
from .session import scratch_path
from .sources import corpus as CORPUS, embed as EMBED, tables as T, vectors as V
from .sources.dictionaries import synthetic_dictionaries
from .sources.manifest import BucketStore

Query = Callable[[SparkSession, str], DataFrame]


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.semantic_search(*fixtures.search_context(spark, sf_dir))


def semantic_search_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with ``prefilter=True``: version and scope filters before the top-50 cut."""
    import dataclasses
    inp, ctx = fixtures.search_context(spark, sf_dir)
    return S.semantic_search(dataclasses.replace(inp, prefilter=True), ctx)


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_search(*fixtures.search_context(spark, sf_dir))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hybrid_search(*fixtures.search_context(spark, sf_dir))


def routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.routed_search(*fixtures.search_context(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "semantic_search": semantic_search,
    "semantic_search_prefilter": semantic_search_prefilter,
    "keyword_search": keyword_search,
    "hybrid_search": hybrid_search,
    "routed_search": routed_search,
}


# ---------------------------------------------------------------------------
# Corpus jobs
# ---------------------------------------------------------------------------



def _v(spark, sf_dir):
    return fixtures.passages(spark, sf_dir)


def corpus_flatten(spark, sf_dir):
    path = CORPUS.write_conversation_corpus(spark, T.table(spark, sf_dir, "conversations"),
                                            scratch_path(spark, "corpus-json"))
    return CORPUS.read_corpus(spark, [path], ["DEF"]).select(
        "ord", "version", "book_short", "book_name", "testament", "book_number", "chapter", "verse", "title",
        "text", "reference", "key")


def corpus_flatten_split(spark, sf_dir):
    """S1 by byte ranges: the files of ``corpus_flatten``, each parsed by as many tasks as it has ranges."""
    path = CORPUS.write_conversation_corpus(spark, T.table(spark, sf_dir, "conversations"),
                                            scratch_path(spark, "corpus-json"))
    return CORPUS.read_corpus(spark, [path], ["DEF"], split=True).select(
        "ord", "version", "book_short", "book_name", "testament", "book_number", "chapter", "verse", "title",
        "text", "reference", "key")


def corpus_strict(spark, sf_dir):
    """The same files without defaults."""
    path = CORPUS.write_conversation_corpus(spark, T.table(spark, sf_dir, "conversations"),
                                            scratch_path(spark, "corpus-json"))
    return CORPUS.read_corpus(spark, [path], ["DEF"], strict=True).select(
        "ord", "version", "book_short", "testament", "book_number", "chapter", "verse", "text")


def corpus_union(spark, sf_dir):
    v = _v(spark, sf_dir)
    parts = [v.filter(F.col("version") == x) for x in ("EN", "FR", "DE", "ES")]
    return R.corpus_union(parts).select("part", "ord", "key")


def dedup_last(spark, sf_dir):
    v = _v(spark, sf_dir).select("ord", "key", "version", "text")
    dup = v.filter(F.col("ord") % 5 == 0).withColumn("ord", F.col("ord") + 1_000_000)
    return R.dedup_last(v.unionByName(dup)).select("key", "ord", "version")


def text_key_map(spark, sf_dir):
    """U3 by embedding text, with every fifth passage loaded again under another key."""
    v = _v(spark, sf_dir)
    again = v.filter(F.col("ord") % 5 == 0).withColumn("ord", F.col("ord") + 1_000_000).withColumn("key", F.concat("key", F.lit("#2")))
    return R.text_key_map(v.unionByName(again))


def corpus_stats(spark, sf_dir):
    return R.corpus_stats(_v(spark, sf_dir))


def load_counts(spark, sf_dir):
    return R.load_counts(_v(spark, sf_dir))


def embedding_text(spark, sf_dir):
    return R.passage_texts(_v(spark, sf_dir)).select("ord", "embedding_text")


def verse_key(spark, sf_dir):
    return R.passage_texts(_v(spark, sf_dir)).select("ord", "key", "reference")


def book_info(spark, sf_dir):
    v = _v(spark, sf_dir)
    return R.book_info(v, R.version_requests(v))


def read_chapter(spark, sf_dir):
    v = _v(spark, sf_dir)
    reqs = v.select(F.col("book_short").alias("req_book"), F.col("chapter").alias("req_chapter"),
                    F.lower("version").alias("req_version")).distinct()
    return R.read_chapter(v, reqs).select("req_book", "req_chapter", "req_version", "ord", "verse", "version",
                                          "total_chapters")


def chapter_response(spark, sf_dir):
    """E5 / W4 with not-found rows: each chapter, the one after it, each chapter without a version, and unknown books."""
    v = _v(spark, sf_dir)

    def ask(book, chapter, version):
        return v.select(book.alias("req_book"), chapter.cast("int").alias("req_chapter"), version.cast("string").alias("req_version"))
    book, chapter = F.col("book_short"), F.col("chapter")
    reqs = (ask(book, chapter, F.lower("version")).unionByName(ask(book, chapter + 1, F.lower("version")))
            .unionByName(ask(F.upper(book), chapter, F.lit(None))).unionByName(ask(F.concat(F.lit("no "), book), chapter, F.col("version"))))
    return R.chapter_responses(v, reqs)


def book_info_response(spark, sf_dir):
    """E6 with not-found rows: each book in each version, unknown books and an unknown version."""
    v = _v(spark, sf_dir)
    reqs = (v.select(F.col("book_short").alias("req_book"), F.lower("version").alias("req_version"))
            .unionByName(v.select(F.concat(F.lit("no "), F.col("book_short")).alias("req_book"), F.col("version").alias("req_version")))
            .unionByName(v.select(F.col("book_short").alias("req_book"), F.lit("Latin").alias("req_version"))))
    return R.book_info_responses(v, reqs)


def chapter_neighbors(spark, sf_dir):
    return R.chapter_neighbors(_v(spark, sf_dir))


def code_crosswalk(spark, sf_dir):
    codes = _v(spark, sf_dir).select(F.col("book_short").alias("code")).distinct()
    return R.code_pairs(codes, synthetic_dictionaries(spark).crosswalk)


def parallel_chapter(spark, sf_dir):
    return R.parallel_chapters(_v(spark, sf_dir), synthetic_dictionaries(spark).crosswalk, "EN", "FR")


def hits_in_context(spark, sf_dir):
    inp, ctx = fixtures.search_context(spark, sf_dir)
    res = S.semantic_search(inp, ctx)
    par = R.parallel_chapters(inp.verses, inp.dicts.crosswalk, "EN", "FR")
    return R.hits_in_context(res, par, inp.dicts.crosswalk)


# ---------------------------------------------------------------------------
# Keyword operators
# ---------------------------------------------------------------------------

KEYWORD_LITERAL = "the"


def keyword_filter_q(spark, sf_dir):
    return keyword_filter(_v(spark, sf_dir), KEYWORD_LITERAL).select("ord", "key")


def _ctx(spark, sf_dir):
    return fixtures.search_context(spark, sf_dir)


def keyword_topk(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    kw = ctx.select("qid", F.col("search_keyword").alias("keyword"))
    # queries with one keyword share its first hits: the cut comes before the join
    hits = top_per_group(keyword_join(inp.verses, kw, index=inp.gram_index()), "keyword", [F.col("ord").asc()], 5)
    return hits.join(kw, "keyword").select("qid", "rank", "ord")


def keyword_join_q(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    return keyword_join(inp.verses, ctx.select(F.col("search_keyword").alias("keyword")), index=inp.gram_index())


def version_alias_filter(spark, sf_dir):
    v = _v(spark, sf_dir)
    d = synthetic_dictionaries(spark)
    filters = (d.version_alias.select(F.col("alias").alias("f"))
               .unionByName(d.version_alias.select(F.col("key").alias("f")))
               .unionByName(v.select(F.lower("version").alias("f")))
               .distinct())
    per_version = v.groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    rules = with_version_rules(filters, d.version_alias, "f")
    j = rules.join(per_version, version_matches("version", "f"), "left")
    return j.groupBy("f").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_match")) \
        .withColumnRenamed("f", "filter")


def scope_filter(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    scoped = ctx.filter(F.col("scope_type") != "NONE").select("qid", "scope_type", "scope_books", "scope_testament")
    # passages are counted by what the rule reads before they meet the queries
    books = inp.verses.groupBy("book_short", "testament").agg(F.count(F.lit(1)).alias("n"))
    met = scoped.join(books, scope_matches(), "left")
    return met.groupBy("qid", "scope_type").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_passages"))


# ---------------------------------------------------------------------------
# Query-log operators
# ---------------------------------------------------------------------------

def validate_queries(spark, sf_dir):
    return C.validate_queries(T.queries(spark, sf_dir)).select("qid", "valid", "error")


def query_tokens_q(spark, sf_dir):
    q = C.validate_queries(T.queries(spark, sf_dir)).filter("valid")
    return q.select("qid", F.posexplode(query_tokens(java_trim("query"))).alias("pos", "token")) \
        .select("qid", F.col("pos").cast("int").alias("pos"), "token")


def keyword_extract(spark, sf_dir):
    q = C.validate_queries(T.queries(spark, sf_dir)).filter("valid")
    d = synthetic_dictionaries(spark)
    return q.select("qid", C.extract_keyword(java_trim("query"), d.stop_words).alias("keyword"))


def reference_parse(spark, sf_dir):
    q = C.validate_queries(T.queries(spark, sf_dir)).filter("valid")
    return C.parse_reference(q, synthetic_dictionaries(spark)).select(
        "qid", "route", "ref_book", "ref_version", "ref_chapter", "ref_verse")


def scope_split(spark, sf_dir):
    q = C.validate_queries(T.queries(spark, sf_dir)).filter("valid").withColumn("trimmed", java_trim("query"))
    return C.split_scope(q).select("qid", "ko_scope", "ko_search", "en_scope", "en_search")


def scope_resolve(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    return ctx.select("qid", "scope_type", F.array_join("scope_books", ",").alias("scope_books"),
                      "scope_testament", "scope_desc", "cleaned_query", "search_query")


def prototype_similarity(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    return ctx.select("qid", *[F.round(c, 6).alias(c) for c in ("kw_sim", "sem_sim", "ctx_sim", "noctx_sim")])


def intent_classify(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    return ctx.select("qid", "intent", "extracted_keyword", "intent_reason", "needs_keyword", "needs_semantic")


def scope_gate(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    return ctx.select("qid", C.scope_skipped(inp.thresholds).alias("skip_scope"), F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------------------
# Vector operators
# ---------------------------------------------------------------------------

def _valid_qvecs(spark, sf_dir):
    q = C.validate_queries(T.queries_with_vectors(spark, sf_dir)).filter("valid")
    return q.select("qid", "qvec")


def cosine_pairs(spark, sf_dir):
    pairs = _cosine_pairs(fixtures.vector_index(spark, sf_dir), _valid_qvecs(spark, sf_dir), min_score=0.1)
    return pairs.select("qid", "ord", F.round("score", 6).alias("score"))


def knn_topk(spark, sf_dir):
    c = knn_candidates(fixtures.vector_index(spark, sf_dir), _valid_qvecs(spark, sf_dir), k=50, min_score=0.1)
    return c.select("qid", "ord", F.round("score", 6).alias("score"), "cand_rank")


def hydrate_candidates(spark, sf_dir):
    c = knn_candidates(fixtures.vector_index(spark, sf_dir), _valid_qvecs(spark, sf_dir), k=50, min_score=0.1)
    return hydrate(c, _v(spark, sf_dir), ["key"]).select("qid", "cand_rank", "key")


def rerank_scores(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    c = knn_candidates(inp.index, ctx.select("qid", F.col("search_vec").alias("qvec")), k=50, min_score=0.1)
    j = hydrate(c, inp.verses, ["text"]).join(ctx.select("qid", "search_query"), "qid")
    return j.select("qid", "ord", F.round("score", 6).alias("score"),
                    F.round(rerank_score("score", "text", "search_query"), 6).alias("reranked_score"))


def score_band(spark, sf_dir):
    return R.with_score_band(semantic_search(spark, sf_dir))


def hybrid_anti(spark, sf_dir):
    inp, ctx = _ctx(spark, sf_dir)
    cands = S.semantic_candidates(inp, ctx)
    return S.not_keyword_hits(cands).select("qid", "ord")


def response_envelope(spark, sf_dir):
    inp, ctx = fixtures.search_context(spark, sf_dir)
    return S.response_envelope(inp, ctx=ctx)


def response_results(spark, sf_dir):
    """Nested responses written by the result sink and read back; their results and context
    books are unfolded, one row each (a query without results has one)."""
    inp, ctx = fixtures.search_context(spark, sf_dir)
    hits = S.routed_search(inp, ctx)
    path = scratch_path(spark, "routed")
    hits.write.parquet(path)
    hits = spark.read.schema(hits.schema).parquet(path)
    nested = S.nested_responses(S.response_envelope(inp, hits, ctx, nested=True), hits)
    uri = S.write_responses(nested, scratch_path(spark, "responses"), "0", fmt="parquet")
    back = spark.read.parquet(uri)
    results = back.select("qid", "success", F.size("results").alias("n_results"), "search_method", F.posexplode_outer("results").alias("pos", "r"))
    books = back.select("qid", "success", F.size("results").alias("n_results"), F.posexplode("context_books").alias("pos", "item"))
    return results.select("qid", "success", "n_results", F.lit("result").alias("part"), "pos", F.col("r.key").alias("item"), "r.reranked_score",
                          F.when(F.col("r").isNotNull(), F.col("search_method")).alias("search_method")).unionByName(
        books.select("qid", "success", "n_results", F.lit("context book").alias("part"), "pos", "item",
                     F.lit(None).cast("double").alias("reranked_score"), F.lit(None).cast("string").alias("search_method")))


def service_stats(spark, sf_dir):
    """A5: one row of service statistics; every aggregate enters as a scalar subquery."""
    v = _v(spark, sf_dir)
    e = T.vectors(spark, sf_dir)
    p = T.prototypes(spark, sf_dir)
    seg = R.passage_texts(v.join(e.select("ord"), "ord"))
    cols = [F.lit(50).alias("candidate_count"), F.lit(5).alias("result_count"), F.lit(0.3).alias("min_score"),
            # distinct by a 128-bit digest, so no text is shuffled
            seg.agg(F.countDistinct(F.md5("embedding_text"))).scalar().alias("indexed_segments"),
            e.agg(F.count(F.lit(1))).scalar().alias("store_size"),                       # A4
            e.agg(F.count(F.lit(1)) > 0).scalar().alias("store_non_empty")]
    for c in ("KEYWORD", "SEMANTIC", "CONTEXT", "NO_CONTEXT"):
        cols.append(p.agg(F.count_if(F.col("class") == c)).scalar().alias(f"n_{c.lower()}_prototypes"))
    stats = R.corpus_stats(v)
    for c in stats.columns:
        cols.append(stats.select(c).scalar().alias(c))
    return spark.range(1).select(*cols)


# ---------------------------------------------------------------------------
# Vector store jobs
# ---------------------------------------------------------------------------

def vector_scan(spark, sf_dir):
    return V.vector_summary(V.scan(T.table(spark, sf_dir, "embeddings")))


def vector_upsert(spark, sf_dir):
    """S5 written: a store of all vectors, a batch that replaces some, and what a reader then sees."""
    e = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    store = BucketStore(spark, scratch_path(spark, "store"), "id long, embedding array<float>, label int, batch int")
    store.append(e.withColumn("batch", F.lit(0)))
    store.upsert(e.filter(F.col("label") < 3).select("id", F.reverse("embedding").alias("embedding"), "label", F.lit(1).alias("batch")))
    return store.read().select(F.col("id").alias("vec_id"), "batch", F.round(F.col("embedding")[0].cast("double"), 6)
                               .alias("first_value"))


def vector_codec_roundtrip(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    enc = V.encode_vectors(e)
    dec = V.decode_vectors(enc.select("vec_id", "blob", F.octet_length("blob").alias("n_bytes")))
    return dec.join(e.withColumnRenamed("embedding", "orig"), "vec_id").select(
        "vec_id", "n_bytes", F.size("embedding").alias("dim"), (F.col("embedding") == F.col("orig")).alias("same"))


def vector_snapshot_roundtrip(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    uri = V.save_snapshot(e, scratch_path(spark, "snapshot"))
    back = V.load_snapshot(spark, uri, "vec_id long, embedding array<float>")
    return V.vector_summary(back)


def vector_append(spark, sf_dir):
    """Two appends of all vectors; the ids are random, so what is shown is that they are distinct."""
    e = T.table(spark, sf_dir, "embeddings").select("embedding")
    store = BucketStore(spark, scratch_path(spark, "store"), V.STORE_SCHEMA)
    for _ in range(2):
        V.append(store, e)
    rows = store.read()
    ids = rows.agg(F.countDistinct("id")).scalar()
    return rows.select("text", F.size("embedding").alias("dim"), F.round(vector_norm("embedding"), 6).alias("norm"), ids.alias("n_ids"))


def index_bootstrap(spark, sf_dir):
    """S8, all three branches: nothing there (generated and saved), the store of that run, and a
    snapshot without a store."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "doc_id long, embedding array<float>"
    store, snapshot = scratch_path(spark, "boot-store"), scratch_path(spark, "boot-snapshot")
    runs = [V.load_or_build_index(spark, store, snapshot, schema, lambda: EMBED.hash_embed(docs)) for _ in range(2)]
    V.save_snapshot(runs[0][1], snapshot)
    runs.append(V.load_or_build_index(spark, scratch_path(spark, "no-store"), snapshot, schema, lambda: EMBED.hash_embed(docs)))
    parts = [df.select(F.lit(i).alias("run"), F.lit(source).alias("source"), "doc_id", F.size("embedding").alias("dim"),
                       F.size(F.filter("embedding", lambda x: x != 0)).alias("n_cells")) for i, (source, df) in enumerate(runs)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def embed_corpus(spark, sf_dir):
    """S9 over the passage table (the reference embeds P1 texts): ord is the doc_id."""
    docs = R.passage_texts(_v(spark, sf_dir)).select(F.col("ord").alias("doc_id"), F.col("embedding_text").alias("text"))
    return EMBED.hash_cells(docs).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def build_report(spark, sf_dir):
    return V.build_report(T.table(spark, sf_dir, "documents"))


QUERIES.update({
    "corpus_flatten": corpus_flatten,
    "corpus_flatten_split": corpus_flatten_split,
    "corpus_strict": corpus_strict,
    "corpus_union": corpus_union,
    "dedup_last": dedup_last,
    "text_key_map": text_key_map,
    "corpus_stats": corpus_stats,
    "load_counts": load_counts,
    "embedding_text": embedding_text,
    "verse_key": verse_key,
    "book_info": book_info,
    "read_chapter": read_chapter,
    "chapter_response": chapter_response,
    "book_info_response": book_info_response,
    "chapter_neighbors": chapter_neighbors,
    "code_crosswalk": code_crosswalk,
    "parallel_chapter": parallel_chapter,
    "hits_in_context": hits_in_context,
    "keyword_filter": keyword_filter_q,
    "keyword_topk": keyword_topk,
    "keyword_join": keyword_join_q,
    "version_alias_filter": version_alias_filter,
    "scope_filter": scope_filter,
    "validate_queries": validate_queries,
    "query_tokens": query_tokens_q,
    "keyword_extract": keyword_extract,
    "reference_parse": reference_parse,
    "scope_split": scope_split,
    "scope_resolve": scope_resolve,
    "prototype_similarity": prototype_similarity,
    "intent_classify": intent_classify,
    "scope_gate": scope_gate,
    "cosine_pairs": cosine_pairs,
    "knn_topk": knn_topk,
    "hydrate_candidates": hydrate_candidates,
    "rerank_scores": rerank_scores,
    "score_band": score_band,
    "hybrid_anti": hybrid_anti,
    "response_envelope": response_envelope,
    "response_results": response_results,
    "service_stats": service_stats,
    "vector_scan": vector_scan,
    "vector_upsert": vector_upsert,
    "vector_codec_roundtrip": vector_codec_roundtrip,
    "vector_snapshot_roundtrip": vector_snapshot_roundtrip,
    "vector_append": vector_append,
    "index_bootstrap": index_bootstrap,
    "embed_corpus": embed_corpus,
    "build_report": build_report,
})


# ---------------------------------------------------------------------------
# Streaming (rows-only checks; stream == batch is tested in tests/)
# ---------------------------------------------------------------------------

def query_log_stream(spark, sf_dir):
    from .streaming.streams import classify_stream
    schema = "conv_id long, turn long, role string, text string"
    return classify_stream(spark, f"{sf_dir.rstrip('/')}/conversations*.parquet", schema,
                           synthetic_dictionaries(spark))


def search_stream(spark, sf_dir):
    """T2 over many micro-batches: the query log as several files, one file a batch."""
    from .streaming.streams import QUERY_SCHEMA, search_stream as run
    src = scratch_path(spark, "t2-queries")
    T.queries(spark, sf_dir).repartition(3, "qid").write.mode("overwrite").parquet(src)
    inp = fixtures.search_inputs(spark, sf_dir)
    return run(spark, f"{src}/*.parquet", QUERY_SCHEMA, inp, T.query_vectors(spark, sf_dir), files_per_batch=1)


def conversation_search(spark, sf_dir):
    """E4 over every turn of ``conversations`` with hash-embedded passages and queries (S9 -> V2
    end to end); intent and search use the vector of the cleaned query."""
    return S.routed_search(fixtures.conversation_inputs(spark, sf_dir))


def phrase_prototypes(spark, sf_dir):
    """V3 and C4's gate with the reference's own phrases as prototypes: every turn of ``conversations``
    against the mean of each class, phrases and turns in one embedder's space."""
    turns = T.table(spark, sf_dir, "conversations").select((F.col("conv_id") * (1 << 32) + F.col("turn")).alias("qid"), "text")
    q = EMBED.with_hash_vector(turns, "text", "qvec").drop("text")
    sims = {"kw_sim": "KEYWORD", "sem_sim": "SEMANTIC", "ctx_sim": "CONTEXT", "noctx_sim": "NO_CONTEXT"}
    near = C.with_class_similarity(q, C.prototype_centroids(fixtures.phrase_prototypes(spark)), sims)
    return near.select("qid", *(F.round(c, 6).alias(c) for c in sims), C.scope_skipped().alias("skip_scope"))


QUERIES.update({"query_log_stream": query_log_stream, "phrase_prototypes": phrase_prototypes, "search_stream": search_stream,
                "conversation_search": conversation_search})
