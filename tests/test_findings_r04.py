"""Findings of round 4, each with a small case that failed before."""
from __future__ import annotations

import collections
import dataclasses
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID
from lectio import fixtures
from lectio.llm import op01_near_vectors
from lectio.operators import filters, scan
from lectio.operators import hydrate as hydration
from lectio.plans import search as S
from lectio.session import scratch_path
from lectio.sources import grams


def shuffled_bytes(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_f1_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(op01_near_vectors, "BLOCK", 64)
    monkeypatch.setattr(op01_near_vectors, "TILE_BYTES", 200_000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x[2000:2100] = x[:100] + rng.normal(size=(100, 64)).astype(np.float32) * np.float32(0.02)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = shuffled_bytes(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op01_near_vectors.near_vectors(frame).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit.sum() >= 200
    assert got == {i: (int(row.sum()), min([i, *np.flatnonzero(row).tolist()])) for i, row in enumerate(hit)}
    # Far vectors of 1 MB in 128 blocks: shipping the pairs shuffled each block 128 times.
    assert shuffled_bytes(spark) - before < 6 * x.nbytes


def test_f2_texts_are_not_shuffled_for_each_candidate(spark, monkeypatch):
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.md5(F.concat(F.col("ord").cast("string"), F.lit("-"), i.cast("string")))))
    inp, ctx = fixtures.search_context(spark, SF_MID)
    path = scratch_path(spark, "long-texts")
    inp.verses.withColumn("text", F.concat("text", F.lit(" "), long)).write.parquet(path)
    inp = dataclasses.replace(inp, verses=spark.read.parquet(path))
    monkeypatch.setattr(hydration, "FEW", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled_bytes(spark)
        one = sorted(map(str, S.semantic_candidates(inp, ctx).collect()))
        # Some 10 KB for each of the candidates before.
        assert len(one) > 200 and shuffled_bytes(spark) - before < 2_000_000
        monkeypatch.setattr(S, "PART_BYTES", 10_000)
        assert sorted(map(str, S.semantic_candidates(inp, ctx).collect())) == one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_f2_many_keywords_are_searched_for_without_lists(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abc üé"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(120)] + ["", None, "a", "x" * 70 + "y"]
    keywords = {t[i:i + n] for t in texts[:60] for n in (1, 2, 3, 4, 5, 7, 8, 15, 16, 31, 32, 33, 64, 65, 150) for i in [rng.randint(0, 200)] if t and len(t) >= i + n}
    keywords |= {"", "x" * 71, "x" * 70, "x" * 32 + "y", "x" * 40 + "z", "nowhere"}
    passages = [(i, t, i % 3, "p") for i, t in enumerate(texts)] + [(5, "abcabc", 5, "q"), (None, "abc", 0, "p")]
    frame = spark.createDataFrame(passages, "ord long, text string, part int, kind string").repartition(3)
    asked = spark.createDataFrame([(k,) for k in sorted(keywords)] + [(None,)], "keyword string")
    index = grams.write_gram_index(frame)
    listed = collections.Counter(map(tuple, filters.keyword_join(frame, asked, carry=["part", "kind"], index=index).collect()))
    want = {(k, i, p, kind) for k in keywords for i, t, p, kind in passages if t is not None and i is not None and i != 5 and k in t}
    assert {x for x in listed if x[1] != 5} == want and len(want) > 2000
    monkeypatch.setattr(filters, "LISTED", 0)

    def no_lists(found, *args, **more):
        assert found.select("ord").distinct().collect() == [(5,)]  # all others are searched for
        return hydrate(found, *args, **more)

    hydrate = filters.hydrate
    monkeypatch.setattr(filters, "hydrate", no_lists)
    assert collections.Counter(map(tuple, filters.keyword_join(frame, asked, carry=["part", "kind"], index=index).collect())) == listed
    monkeypatch.setattr(scan, "PART_BYTES", 2000)
    got = collections.Counter(map(tuple, filters.keyword_join(frame, asked, carry=["part", "kind"], index=index, first=2).collect()))
    least = collections.Counter()
    for k, p, kind in {(k, p, kind) for k, _, p, kind in want}:
        least.update((k, i, p, kind) for i in sorted(i for w, i, q, r in want if (w, q, r) == (k, p, kind))[:2])
    assert not got - listed and not least - got
