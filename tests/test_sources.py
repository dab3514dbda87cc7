"""Corpus ingest (S1/S2), bootstrap order (S8) and snapshots (S7) beyond the oracle sweep."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lectio.session import scratch_path
from lectio.sources import corpus as CORPUS
from lectio.sources import embed as EMBED
from lectio.sources import tables as T
from lectio.sources import vectors as V


def _write(path, doc):
    import os
    path = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/doc.json", "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2)       # multi-line, like the reference's files


DOC = {"books": [
    {"bookName": "Genesis", "bookShort": "Gen", "chapters": [
        {"chapter": 1, "verses": [{"verse": 1, "text": "In the beginning", "title": "Creation"},
                                  {"verse": 2}]}]},
    {"bookName": "Empty", "bookShort": "E"},
    {"bookName": "Exodus", "bookShort": "Ex", "testament": 1, "bookNumber": 2,
     "chapters": [{"chapter": 3}, {"chapter": 4, "verses": [{"verse": 1, "text": "x", "title": None}]}]}]}


def test_ingest_defaults_and_skips(spark):
    base = scratch_path(spark, "corpus-test")
    _write(base, DOC)
    rows = CORPUS.read_corpus(spark, [base, base + "-missing"], ["ASV", "KRV"]).orderBy("ord").collect()
    assert [(r["book_short"], r["chapter"], r["verse"], r["text"], r["title"], r["version"], r["testament"])
            for r in rows] == [("Gen", 1, 1, "In the beginning", "Creation", "ASV", 0),
                               ("Gen", 1, 2, "", None, "ASV", 0),
                               ("Ex", 4, 1, "x", None, "ASV", 1)]
    assert rows[0]["reference"] == "Genesis 1:1" and rows[2]["key"] == "ASV:Ex:4:1"


def test_ingest_strict_mode(spark):
    base = scratch_path(spark, "corpus-strict")
    _write(base, DOC)
    rows = CORPUS.read_corpus(spark, [base], ["ASV"], strict=True).orderBy("ord").collect()
    assert [r["text"] for r in rows] == ["In the beginning", "null", "x"]
    assert all(r["version"] is None for r in rows) and rows[0]["testament"] is None


def test_bootstrap_prefers_store_then_snapshot(spark):
    e = T.table(spark, SF_SMALL, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    schema = "doc_id long, embedding array<float>"
    store, snap = scratch_path(spark, "store"), scratch_path(spark, "snap")
    built = lambda: EMBED.hash_embed(T.table(spark, SF_SMALL, "documents").select("doc_id", "text"))
    assert V.load_or_build_index(spark, store, snap, schema, built)[0] == "generated"
    # the generated index is saved, so the next start finds it
    src, df = V.load_or_build_index(spark, store, snap, schema, built)
    assert src == "store" and df.count() == built().count()
    V.save_snapshot(e, snap)
    assert V.load_or_build_index(spark, scratch_path(spark, "store"), snap, schema, built)[0] == "snapshot"
    e.write.mode("overwrite").parquet(store)
    src, df = V.load_or_build_index(spark, store, snap, schema, built)
    assert src == "store" and df.count() == e.count()


def test_hash_embedding_is_unit_or_zero(spark):
    docs = spark.createDataFrame([(1, "love one another"), (2, "   "), (3, "Love LOVE love")], "doc_id long, text string")
    out = {r["doc_id"]: r["embedding"] for r in EMBED.hash_embed(docs).collect()}
    import math
    assert abs(math.sqrt(sum(x * x for x in out[1])) - 1) < 1e-6
    assert all(x == 0 for x in out[2])
    assert sum(1 for x in out[3] if x != 0) == 1        # one token three times: one bucket


def test_snapshot_exists_and_delete(spark):
    e = T.table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding")
    uri = scratch_path(spark, "snap-del")
    assert not V.snapshot_exists(spark, uri)
    V.save_snapshot(e, uri)
    assert V.snapshot_exists(spark, uri)
    V.delete_snapshot(spark, uri, "vec_id long, embedding array<float>")
    assert not V.snapshot_exists(spark, uri)


def test_result_sink_nested_and_partitioned_by_run(spark):
    from lectio import fixtures
    from lectio.plans import search as S
    inp, ctx = fixtures.search_context(spark, SF_SMALL)
    res = S.routed_search(inp, ctx)
    env = S.response_envelope(inp, res, ctx)
    nested = S.nested_responses(env, res)
    uri = scratch_path(spark, "responses")
    S.write_responses(nested, uri, "r1")
    S.write_responses(nested, uri, "r2")
    back = spark.read.json(uri)
    assert back.select("run").distinct().count() == 2
    one = back.filter("run = 'r1'")
    assert one.count() == env.count()
    sizes = {r["qid"]: r["n"] for r in one.select("qid", F.size("results").alias("n")).collect()}
    assert sizes == {r["qid"]: r["total_results"] for r in env.collect()}


def test_store_shows_whole_writes_only(spark):
    """An upsert rewrites the buckets it touches; a write that dies before its commit is not seen."""
    from lectio.sources.manifest import BucketStore
    store = BucketStore(spark, scratch_path(spark, "bucket-store"), "id long, x int", buckets=8)
    assert store.read().count() == 0
    store.append(spark.range(100).select("id", F.lit(0).alias("x")))
    before = dict.fromkeys(range(100), 0)
    assert {r.id: r.x for r in store.read().collect()} == before
    batch = spark.createDataFrame([(3, 1, 0), (3, 7, 1), (200, 5, 2)], "id long, x int, at int")
    store.write_data(batch.select("id", "x"))          # killed here: folders without a manifest
    assert {r.id: r.x for r in store.read().collect()} == before
    _, old = store._state()
    store.upsert(batch, arrival="at")
    _, new = store._state()
    touched = {r[0] for r in batch.select(store.bucket()).distinct().collect()}
    assert {p for p in old if p[0] not in touched} == {p for p in new if p[0] not in touched}
    assert {r.id: r.x for r in store.read().collect()} == before | {3: 7, 200: 5}
    store.upsert(batch.limit(0).select("id", "x"))
    store.append(spark.createDataFrame([(300, 1)], "id long, x int"))
    assert store.read().count() == 102


def test_store_of_repeated_appends(spark):
    from lectio.sources.manifest import BucketStore
    store = BucketStore(spark, scratch_path(spark, "bucket-store"), V.STORE_SCHEMA, buckets=4)
    e = T.table(spark, SF_SMALL, "embeddings").select("embedding")
    for _ in range(2):
        V.append(store, e)
    assert store.read().select("id").distinct().count() == 2 * e.count()


def test_epoch_that_runs_again_replaces_its_rows(spark):
    from lectio.sources.manifest import EpochSink
    sink = EpochSink(spark, scratch_path(spark, "epochs"), "a long, b string")
    assert sink.read().count() == 0
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "b string, a long")
    sink.write(rows, 0)
    sink.write(rows.filter("a = 1"), 1)
    sink.write(rows.filter("a = 2"), 0)
    assert sorted(tuple(r) for r in sink.read().collect()) == [(1, "x"), (2, "y")] and sink.read().columns == ["a", "b"]


AWKWARD_TEXTS = ['plain', '', None, 'a {brace} and }}{{ [list], "quoted"', 'ends in a backslash \\', '\\" {', '{"verse": 9}',
                 'é\U0001F600 { \t\n }', ',', ']', '"verses":[', '\\\\{\\\\', '{' * 40 + '"' * 7 + '}' * 3]


def _large_document(n_books):
    texts = lambda b, c: [{"verse": i + 1, "text": t, "title": None if i % 2 else f"t{{{b}.{c}}}"} for i, t in enumerate(AWKWARD_TEXTS)]
    books = [{"bookName": f"B {{{b}}}", "bookShort": f"b{b}", "chapters": [{"chapter": c, "verses": texts(b, c)} for c in range(3)]
              + [{"chapter": 9}, {"verses": [{"verse": 1}, {}], "chapter": 10}], "testament": b % 2, "tags": [1, "x]"], "bookNumber": b}
             for b in range(n_books)]
    return {"books": [*books, {"bookName": "Empty", "bookShort": "E", "chapters": []}, {"bookName": "No", "chapters": None}], "version": "V,{1}"}


def test_ingest_by_byte_ranges_equals_whole_files(spark):
    import os
    base = scratch_path(spark, "corpus-split")
    folder = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(folder)
    for name, indent, n in (("a", None, 6), ("b", 2, 4), ("c", 1, 0)):
        with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
            json.dump(_large_document(n), f, ensure_ascii=name == "b", indent=indent)
    whole = [tuple(r) for r in CORPUS.read_corpus(spark, [base, base], ["X", "Y"]).orderBy("ord").collect()]
    ords = [r.ord for r in CORPUS.read_corpus(spark, [base, base], ["X", "Y"]).select("ord").orderBy("ord").collect()]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("511", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = CORPUS.read_corpus(spark, [base, base], ["X", "Y"], split=True)
            assert [tuple(r) for r in got.orderBy("ord").collect()] == whole, size
            if size == "511":
                assert spark.read.text(f"{base}/a.json").rdd.getNumPartitions() > 20
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(whole) == 2 * 10 * (3 * len(AWKWARD_TEXTS) + 2) and ords == list(range(len(whole)))


def test_ingest_by_byte_ranges_refuses_other_objects(spark):
    import pytest
    for extra in ({"meta": {"a": 1}}, {"notes": [{"a": 1}]}):
        base = scratch_path(spark, "corpus-other")
        _write(base, {**extra, **DOC})
        with pytest.raises(Exception, match="split=False"):
            CORPUS.read_corpus(spark, [base], split=True).count()
