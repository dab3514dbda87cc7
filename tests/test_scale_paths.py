"""The paths taken beyond each size check must give the same rows as the primary ones:
query blocks beyond the broadcast bytes (k-NN), the gram index, and degenerate vectors."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lectio import fixtures
from lectio.operators.filters import keyword_join
from lectio.operators.knn import cosine_pairs, knn_candidates
from lectio.sources import tables as T


def _set(df, cols):
    return {tuple(r) for r in df.select(*cols).collect()}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])   # query blocks broadcast, or dealt to the grid
def test_knn_grid_equals_one_tile(spark, broadcast_bytes):
    vec = T.vectors(spark, SF_SMALL)
    q = T.query_vectors(spark, SF_SMALL)
    one = knn_candidates(vec, q, k=10, min_score=0.1)
    many = knn_candidates(vec, q, k=10, min_score=0.1, block_rows=16, broadcast_bytes=broadcast_bytes,
                          cell_bytes=1 << 14, fan=4)   # many tiles, a merge tree of two levels
    cols = ["qid", "ord", "cand_rank"]
    assert _set(one, cols) == _set(many, cols)
    pairs = cosine_pairs(vec, q, 0.3)
    tiled = cosine_pairs(vec, q, 0.3, block_rows=16, broadcast_bytes=broadcast_bytes, cell_bytes=1 << 14)
    assert pairs.count() == tiled.count() and _set(pairs, ["qid", "ord"]) == _set(tiled, ["qid", "ord"])


def test_knn_state_is_shipped_when_full(spark, monkeypatch):
    from lectio.operators import knn
    vec, q = T.vectors(spark, SF_SMALL).repartition(1), T.query_vectors(spark, SF_SMALL).filter("qid < 40")
    want = _set(knn_candidates(vec, q, k=5), ["qid", "ord", "cand_rank"])
    kernel = knn._tile_kernel

    def small(*args):
        made = kernel(*args)

        def run(batches):
            knn.STATE_BYTES = 1      # set in the worker
            yield from made(batches)
        return run
    monkeypatch.setattr(knn, "_tile_kernel", small)
    assert _set(knn_candidates(vec, q, k=5, block_rows=16), ["qid", "ord", "cand_rank"]) == want


def test_keyword_join_over_written_index(spark):
    v = fixtures.passages(spark, SF_SMALL)
    kws = (T.table(spark, SF_SMALL, "benchmark")
           .select(F.explode(F.split("text", " ")).alias("keyword")).distinct())
    found = keyword_join(v, kws, carry=["version"], index=fixtures.gram_index(spark, SF_SMALL))
    cols = ["keyword", "ord", "version"]
    plain = v.join(F.broadcast(kws), F.col("text").contains(F.col("keyword")))
    assert _set(found, cols) == _set(plain, cols) and found.count() == plain.count() > 0


def test_keyword_join_equals_contains(spark):
    """The empty keyword is in every text, null is in none, keywords overlap, signs and
    line ends are literal."""
    texts = ["abc", "xyz", "", None, "a\nb.c abab", "😀é😀x", "aaa", "q" * 20_000 + "abz"]
    words = ["", "b", "ab", "abc", "aba", "bab", "a\nb", ".c", "....", "😀é😀", "é", "aaaa", None, "zz", "qqqabz", "abzq"]
    v = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    kws = spark.createDataFrame([(w,) for w in words + words[:3]], "keyword string")
    want = sorted((w, i) for w in words if w is not None for i, t in enumerate(texts) if t is not None and w in t)
    assert sorted(tuple(r) for r in keyword_join(v, kws).collect()) == want
    assert keyword_join(v.limit(0), kws).count() == 0 and keyword_join(v, kws.limit(0)).count() == 0


def test_gram_lists_equal_plain_windows(monkeypatch):
    import random
    from lectio.sources import grams
    draw = random.Random(1)
    for chars in (5, 7, 1 << 20):
        monkeypatch.setattr(grams, "RUN_CHARS", chars)
        for _ in range(30):
            texts = ["".join(draw.choice("abé😀\n ") for _ in range(draw.choice([0, 0, 1, 2, 3, 8, 25]))) for _ in range(draw.choice([1, 2, 9]))]
            ords = [3 * i for i in range(len(texts))]
            made = grams._lists(ords, texts)
            got = dict(zip(made.column(0).to_pylist(), made.column(1).to_pylist()))
            want: dict = {}
            for i, t in zip(ords, texts):
                for g in {t[j:j + k] for k in range(4) for j in range(len(t) - k + 1)}:
                    want.setdefault(g, []).append(i)
            assert got == want and made.num_rows == len(got)


def test_hydrate_ranges(spark):
    from lectio.operators.hydrate import hydrate, key_ranges
    keys = spark.createDataFrame([(x,) for x in (5, 6, 5000, 5100, 900_000, 10**12)], "ord long")
    assert key_ranges(keys) == [(5, 6), (5000, 5100), (900_000, 900_000), (10**12, 10**12)]
    few = key_ranges(keys, ranges=3)
    assert len(few) <= 3 and all(any(lo <= r.ord <= hi for lo, hi in few) for r in keys.collect())
    assert key_ranges(keys.limit(0)) == [] and hydrate(keys.limit(0), keys.withColumn("x", F.lit(1)), ["x"]).count() == 0
    rows = spark.range(0, 10_000).select(F.col("id").alias("ord"), (F.col("id") * 2).alias("x"))
    assert {(r.ord, r.x) for r in hydrate(keys, rows, ["x"]).collect()} == {(5, 10), (6, 12), (5000, 10_000), (5100, 10_200)}


def test_zero_and_mismatched_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.6, 0.8])],
                                   "ord long, embedding array<float>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0])], "qid long, qvec array<float>")
    got = {(r["qid"], r["ord"]): r["score"] for r in knn_candidates(corpus, q, k=5, min_score=-1.0).collect()}
    assert got[(10, 1)] == 1.0 and abs(got[(10, 4)] - 0.6) < 1e-7
    assert got[(10, 2)] == 0.0                 # zero corpus vector scores 0
    assert (10, 3) not in got                  # no vector is never a candidate
    wide = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "ord long, embedding array<float>")
    met = knn_candidates(wide, q, k=5, min_score=-1.0).filter("qid = 10").collect()
    assert [r["ord"] for r in met] == [1]      # widths that differ never meet
    assert all(v == 0.0 for (qid, _), v in got.items() if qid == 11)   # zero query vector


def test_fewer_matches_than_k_and_threshold(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "ord long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qvec array<float>")
    got = knn_candidates(corpus, q, k=50, min_score=0.1).collect()
    assert [(r["ord"], r["cand_rank"]) for r in got] == [(1, 1)]
    exact = knn_candidates(corpus, q, k=50, min_score=1.0).collect()   # threshold is inclusive
    assert [r["ord"] for r in exact] == [1]


def test_relevance_score_mode(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "ord long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qvec array<float>")
    got = {r["ord"]: r["score"] for r in knn_candidates(corpus, q, k=5, min_score=0.0, score_mode="relevance").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5}


def test_sliced_arrow_columns():
    """A slice of an Arrow list column keeps offsets into the whole child buffer."""
    import numpy as np
    import pyarrow as pa
    from lectio.operators.knn import _doubles
    from lectio.sources.vectors import _decode, _encode
    col = pa.array([[1.0, 0.0], [0.0, 1.0], [2.0, 2.0]], pa.list_(pa.float32()))
    assert np.array_equal(_doubles(col.slice(1), 0), [0.0, 1.0])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), col], names=["id", "embedding"]).slice(1)
    back = next(_decode(iter([next(_encode(iter([batch])))])))
    assert back.column("embedding").to_pylist() == [[0.0, 1.0], [2.0, 2.0]]


def test_upsert_last_of_batch_wins(spark):
    from lectio.sources.vectors import upsert
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", 9, 0), ("b", 3, 1), ("c", 4, 2)], "id string, x int, at int")
    got = {r["id"]: (r["x"], r["batch"]) for r in upsert(old, new, arrival="at").collect()}
    assert got == {"a": (1, 0), "b": (3, 1), "c": (4, 1)}


def test_long_number_is_no_reference(spark):
    from lectio.operators.classify import parse_reference
    from lectio.sources.dictionaries import reference_dictionaries
    q = spark.createDataFrame([(1, "John 99999999999"), (2, "John 3:99999999999"), (3, "John 3:16")], "qid long, query string")
    got = {r["qid"]: (r["route"], r["ref_chapter"], r["ref_verse"]) for r in parse_reference(q, reference_dictionaries(spark)).collect()}
    assert got == {1: ("SEARCH", None, None), 2: ("READ", 3, None), 3: ("READ", 3, 16)}


def test_parallel_chapters_korean_label(spark):
    from lectio.plans.reader import parallel_chapters
    v = spark.createDataFrame([("ASV", "Gen", 1, 1, "in the beginning"), ("개역개정", "창", 1, 1, "태초에")],
                              "version string, book_short string, chapter int, verse int, text string")
    cw = spark.createDataFrame([("Gen", "창")], "code_a string, code_b string")
    row = parallel_chapters(v, cw, "ASV", "KRV").filter("verse = 1").first()
    assert (row["text_a"], row["text_b"]) == ("in the beginning", "태초에")
