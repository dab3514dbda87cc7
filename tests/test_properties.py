"""Properties of the vector kernel, the codec and the searches."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lectio import fixtures
from lectio.functions.vector import cosine
from lectio.operators.knn import knn_candidates
from lectio.plans import search as S
from lectio.sources import tables as T
from lectio.sources import vectors as V


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 0.0], [0.0, 1.0]),
                                ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert got[0] == pytest.approx(1.0)
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.0])


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_knn_equals_bruteforce_any_partitioning(spark, parts):
    vec = T.vectors(spark, SF_SMALL).repartition(parts)
    q = T.query_vectors(spark, SF_SMALL).filter(F.col("qid") < 15)
    got = knn_candidates(vec, q, k=7, min_score=0.1).select("qid", "ord", "cand_rank").collect()
    V_ = vec.orderBy("ord").toPandas()
    Q_ = q.orderBy("qid").toPandas()
    m = np.vstack(V_["embedding"].map(np.asarray))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for qid, qv in zip(Q_["qid"], Q_["qvec"]):
        qv = np.asarray(qv, dtype=float)
        s = m @ (qv / np.linalg.norm(qv))
        order = sorted(range(len(s)), key=lambda i: (-round(float(s[i]), 12), int(V_["ord"][i])))
        order = [i for i in order if s[i] >= 0.1][:7]
        want |= {(int(qid), int(V_["ord"][i]), r + 1) for r, i in enumerate(order)}
    assert {(r["qid"], r["ord"], r["cand_rank"]) for r in got} == want


def test_codec_roundtrip_and_ragged_tail(spark):
    df = spark.createDataFrame([(1, [1.5, -2.25, 3.0]), (2, [])], "vec_id long, embedding array<float>")
    back = V.decode_vectors(V.encode_vectors(df)).orderBy("vec_id").collect()
    assert back[0]["embedding"] == [1.5, -2.25, 3.0] and back[1]["embedding"] == []
    ragged = spark.createDataFrame([(1, bytearray(np.asarray([1.0, 2.0], "<f4").tobytes() + b"\x01\x02"))],
                                   "vec_id long, blob binary")
    assert V.decode_vectors(ragged).first()["embedding"] == [1.0, 2.0]


@pytest.fixture(scope="module")
def ctx(spark):
    return fixtures.search_context(spark, SF_SMALL)


def test_hybrid_has_no_duplicate_keys_and_respects_k(spark, ctx):
    inp, c = ctx
    res = S.hybrid_search(inp, c)
    dup = res.groupBy("qid", "key").count().filter("count > 1").count()
    assert dup == 0
    assert res.groupBy("qid").count().filter("count > 5").count() == 0


def test_scores_in_unit_interval(spark, ctx):
    inp, c = ctx
    res = S.routed_search(inp, c)
    bad = res.filter((F.col("reranked_score") < 0) | (F.col("reranked_score") > 1)).count()
    assert bad == 0


def test_empty_query_table(spark, ctx):
    inp, _ = ctx
    empty = dataclasses.replace(inp, queries=inp.queries.limit(0))
    assert S.semantic_search(empty).count() == 0
    assert S.response_envelope(empty).count() == 0


def test_blank_queries_become_error_rows(spark, ctx):
    inp, c = ctx
    env = S.response_envelope(inp, ctx=c)
    errs = env.filter(~F.col("success")).collect()
    assert errs and all(r["error"] == "Query cannot be empty" and r["total_results"] == 0 and r["query"] is None
                        for r in errs)


def test_vector_of_another_width_fails_alone(spark, ctx):
    """One bad query is an error row; the others are answered as if it weren't there."""
    inp, c = ctx
    bad = c.filter(F.col("needs_semantic")).agg(F.min("qid")).first()[0]
    wide = dataclasses.replace(inp, queries=inp.queries.withColumn("qvec", F.when(F.col("qid") == bad, F.array_repeat(F.lit(0.5).cast("float"), 7)).otherwise(F.col("qvec"))))
    mixed = S.query_context(wide)
    failed = mixed.filter("error is not null").collect()
    assert [(r["qid"], r["error"]) for r in failed] == [(bad, S.ERROR_WIDTH)]
    got = {r["qid"]: r for r in S.response_envelope(wide, ctx=mixed).collect()}
    want = {r["qid"]: r for r in S.response_envelope(inp, ctx=c).collect()}
    assert (got[bad]["success"], got[bad]["error"], got[bad]["total_results"]) == (False, S.ERROR_WIDTH, 0)
    assert {q: r for q, r in got.items() if q != bad} == {q: r for q, r in want.items() if q != bad}


def test_cleaned_query_has_its_own_vector(spark, ctx):
    """Scope is judged on the whole query, intent and search on what is left of it."""
    from lectio.sources.embed import hash_embed, with_hash_vector
    inp, _ = ctx
    q = spark.createDataFrame([(1, "in src3 about love and mercy"), (2, "love and mercy")], "qid long, query string")
    rows = q.select("qid", "query", F.lit(None).cast("int").alias("max_results"), F.lit(None).cast("double").alias("min_score"), F.lit(None).cast("string").alias("version"))
    qvec = hash_embed(q.select("qid", "query"), "qid", "query").withColumnRenamed("embedding", "qvec")
    open_gate = dataclasses.replace(inp.thresholds, scope_difference=9.0)
    made = S.query_context(dataclasses.replace(inp, queries=rows.join(qvec, "qid"), embed=with_hash_vector, thresholds=open_gate))
    got = {r["qid"]: r for r in made.collect()}
    assert got[1]["search_query"] == "love and mercy" and got[1]["search_vec"] == got[2]["search_vec"] == got[2]["qvec"] != got[1]["qvec"]


@pytest.mark.parametrize("dim", [7, 64, 384])
def test_hash_embedding_of_any_width(spark, dim):
    import hashlib
    import re
    from lectio.sources.embed import embed_distinct, hash_embed
    texts = ["A b  c a", None, "", " x\ty\n x É", "A b  c a", "w " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in hash_embed(docs, dim=dim).collect()}
    for i, text in enumerate(texts):
        v = np.zeros(dim)
        for w in filter(None, re.split(r"\s+", (text or "").lower())):
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % dim] += 1 if int(h[8], 16) % 2 == 0 else -1
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1), atol=1e-6)
    seen = spark.sparkContext.accumulator(0)

    def counted(frame):
        seen.add(frame.count())
        return hash_embed(frame, dim=dim)
    assert {r[0]: r[1] for r in embed_distinct(docs, counted).collect()} == got and seen.value == 4


def test_routed_search_independent_of_shuffle_width(spark, ctx):
    inp, c = ctx
    rows = {}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            rows[width] = sorted(tuple(r) for r in S.routed_search(inp, c).select("qid", "rank", "key", "score").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows["1"] == rows["16"] and rows["1"]
