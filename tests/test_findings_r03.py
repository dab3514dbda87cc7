"""Findings of round 3: work done once, on narrow rows, in bounded pieces."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lectio import fixtures
from lectio.plans import search as S


def test_matched_words_stop_at_the_full_boost(spark):
    """words after the one that fills the boost aren't searched for; a repeated word counts each time."""
    from lectio.operators.rerank import matched_words, query_words, rerank_score
    rows = spark.createDataFrame([("one two three four five six", "ONE two three four five six", 0.1), ("one", "one one two", 0.1),
                                  ("x" * 301, "is no word of it", 0.5), (None, "two", 0.2), ("abc", "", 0.3)], "text string, q string, score double")
    got = rows.select(matched_words("text", query_words("q")).alias("n"), F.round(rerank_score("score", "text", "q"), 9).alias("r")).collect()
    assert [tuple(r) for r in got] == [(4, 0.3), (2, 0.2), (0, 0.475), (0, 0.2), (0, 0.3)]


def test_candidates_are_scored_once_and_narrow(spark):
    """candidates reach the branches as written rows without texts; passages that share an ord stay apart."""
    import dataclasses
    inp, ctx = fixtures.search_context(spark, SF_SMALL)
    cands = S.semantic_candidates(inp, ctx)
    assert not {"text", "title", "search_query"} & set(cands.columns)
    assert "ArrayAggregate" not in cands._jdf.queryExecution().executedPlan().toString()
    twice = dataclasses.replace(inp, verses=inp.verses.unionByName(inp.verses.withColumn("verse", F.col("verse") + 1000).withColumn("text", F.concat("text", F.lit(" again")))))
    one = S.semantic_candidates(inp, ctx).filter("min_score <= 0.3")
    two = S.semantic_candidates(twice, ctx).filter("min_score <= 0.3")
    assert two.filter("verse <= 1000").count() == one.count() and two.count() == 2 * one.count() > 0
    both = S.with_passages(two.select("qid", "ord", *S.IDENTITY), twice.verses)
    assert both.count() == two.count() and both.filter("(verse > 1000) <> endswith(text, ' again')").isEmpty()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gram_lists_of_many_characters_and_zeros():
    """a run whose characters don't fit one number is halved; no gram is lost."""
    from lectio.sources import grams
    every = [chr(c) for c in range(0x100, 0xD000)] + [chr(c) for c in range(0xE000, 0x90000)]
    texts = ["".join(every[i::30]) for i in range(30)] + ["\0a\0", "", "\0"]
    made = list(grams._fitting(list(range(len(texts))), texts))
    assert len(made) > 1 and grams._lists(list(range(len(texts))), texts) is None
    got = {(g, o) for b in made for g, os in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for o in os}
    assert got == {(t[j:j + k], i) for i, t in enumerate(texts) for k in range(4) for j in range(len(t) - k + 1)}


def test_keywords_meet_postings_unshuffled(spark, monkeypatch):
    """the lists of a few keywords' grams are filtered where they are read; beyond the bytes, the same rows."""
    from lectio.operators.filters import keyword_join
    from lectio.sources import grams
    v = spark.createDataFrame([(1, "abcd"), (2, "bcde"), (3, "x"), (3, "abce")], "ord long, text string")
    kws = spark.createDataFrame([("abc",), ("bcde",), ("e",), ("zzz",)], "keyword string")
    index = grams.write_gram_index(v)
    found = grams.candidates(index, kws)
    assert "BroadcastHashJoin" in _plan(found) and "Exchange hashpartitioning" not in _plan(found)
    want = sorted(map(tuple, keyword_join(v, kws, index=index).collect()))
    for size in (100, 0):
        monkeypatch.setattr(grams, "BROADCAST_BYTES", size)
        assert sorted(map(tuple, keyword_join(v, kws, index=index).collect())) == want and want


def test_context_search_builds_no_gram_index(spark, monkeypatch):
    """a search that asks for no keyword needs no gram index."""
    def never(*args):
        raise AssertionError("the gram index was built")
    monkeypatch.setattr(fixtures, "gram_index", never)
    import __spark_entry__ as E
    assert E.queries()["hits_in_context"](spark, SF_SMALL).count() > 0


def test_vectors_are_counted_in_pieces(spark, monkeypatch):
    """no array of a task covers more than PIECE tokens (or one text's), and texts aren't carried along."""
    from lectio.sources import embed
    rows = spark.createDataFrame([(i, "w " * (i % 5 * 40) + "end") for i in range(60)] + [(60, None)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, embed.hash_embed(rows).collect()))
    over, weights, seen = embed.PIECE, embed._weights, spark.sparkContext.accumulator(0)

    def small(tokens, dim):
        seen.add(1)
        offsets = tokens.offsets.to_pylist()
        assert len(tokens) == 1 or offsets[-1] - offsets[0] <= 200
        return weights(tokens, dim)
    monkeypatch.setattr(embed, "PIECE", 200)
    import pyarrow as pa
    made = []
    class Frame:      # the task's function, run here
        columns, schema = ["doc_id", "text"], rows.schema
        def select(self, *cols):
            assert cols[0] == "doc_id" and len(cols) == 2
            return self
        def mapInArrow(self, run, schema):
            made.append(run)
    embed.hash_embed(Frame())
    monkeypatch.setattr(embed, "_weights", small)
    batch = pa.record_batch([pa.array([r.doc_id for r in rows.collect()]), pa.array([(r.text or "").split() for r in rows.collect()])], ["doc_id", "tokens"])
    got = [x for b in made[0](iter([batch.slice(7), batch.slice(0, 7)])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted((i, [float(x) for x in v]) for i, v in got) == [(i, list(v)) for i, v in want] and seen.value > 3 and over > 200


def test_passages_shuffle_their_texts_once(spark):
    """F8: one exchange, by ranges of chapters, serves the verse numbers and the layout by ord."""
    from lectio.sources import tables
    plan = _plan(tables.verses(spark, SF_SMALL).sortWithinPartitions("ord"))
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan


def test_split_levels_share_one_plan(spark):
    """pipeline: a level of the splitting tree reads what the last one wrote; no plan holds them all."""
    from lectio.llm import op07_mixing
    quotas = spark.createDataFrame([("a", 40), ("b", 7), (None, 3)], "source string, blocks int")
    leaves = op07_mixing.split_tree(quotas)
    assert "Window" not in _plan(leaves)
    sums = {r[0]: r[1] for r in leaves.groupBy("source").sum("quota").collect()}
    assert sums == {"a": 40, "b": 7, None: 3}
    assert leaves.groupBy("shard").agg(F.sum("quota").alias("n")).filter("n > 2 or shard > 31").isEmpty()
