"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with
DataFrame functions only.

Sizes are words. Targets share 100% of all sizes by weight, stop at three times a source's size,
and what that leaves over is shared again by weight (water filling). A source is dealt, by a
hash permutation of its documents, into ``BLOCKS`` blocks. Its quota is a number of whole passes
over its blocks and, for the rest, its first blocks in permuted order; the block at the edge is
cut at the last document that fits. What that leaves open is cut again, from the undrawn documents
of all blocks that are no larger than what is left, until none fits; the document of the nearest
size then goes in if that brings the source nearer. A source of any size has as many blocks,
so the tables of blocks are small, and no window sees more than one block's documents.

The shards are the leaves of a binary tree. Every node holds block quotas by source; its blocks
are split between its children without replacement (a random permutation of the node's blocks,
cut in the middle), which is a multivariate-hypergeometric draw of the children's quotas. A leaf
then takes its quota from each source's permuted blocks at its own offset, so shards draw
disjoint blocks, and orders its documents by a hash: a local shuffle.

All randomness is a hash of ids and a seed: reruns agree.

Defined cases: null text: size 0; null source: a source of its own, after all others; sources of
size 0: target 0, nothing taken; equal rows each keep their row and are drawn alike; null ids hash as any
value; an empty table gives no rows; columns of the input keep their values, but for those that
``mixed`` makes itself (size, source_size, target, taken, shards), which replace input columns of
their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio.llm.components import written

# Weights of the sources in order, repeating; copies of a document at most.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3

BLOCKS = 256
#: The tree's depth: 2 ** LEVELS shards.
LEVELS = 5
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def uniform(*columns: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11)).cast("double") / F.lit(float(1 << 53))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.
    The windows run over the table of sources."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    w = sources.withColumn("weight", weight.cast("double"))
    # A source is full below the water level at ratio = MOST_COPIES * size / weight.
    w = w.withColumn("full", (F.col("source_size") * MOST_COPIES).cast("double")).withColumn("ratio", F.col("full") / F.col("weight"))
    every = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double"))
    w = w.withColumn("left_words", F.col("total") - F.coalesce(F.sum("full").over(upto), F.lit(0.0)))
    w = w.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # The level if this source is the first that isn't full; the first that holds decides.
    w = w.withColumn("level", F.col("left_words") / F.col("left_weight"))
    w = w.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return w.select("source", "source_size", "weight", F.least(F.col("full"), F.coalesce("water", F.lit(0.0)) * F.col("weight")).alias("target"))


def split_tree(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(source, shard, quota) from (source, blocks): at every level each node's blocks are put in
    a random order and cut in the middle, so the children's quotas by source are drawn from the
    multivariate hypergeometric distribution. Rows are blocks: a bounded number for a source."""
    units = quotas.select("source", F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("unit"))
    quota = units.withColumn("node", F.lit(0)).withColumn("seed", F.lit(SEED))
    for _ in range(levels):
        # A level is one small job. The seed is a column, so every level has the same plan, whose
        # compiled code the driver and the executors hold once.
        quota = written(quota, "mix-split")
        within = Window.partitionBy("node")
        rank = F.row_number().over(within.orderBy(F.xxhash64("seed", "source", "unit"), "source", "unit"))
        held = F.count("*").over(within)
        # The odd block of a node goes left or right by the node's hash.
        half = F.floor((held + F.pmod(F.xxhash64("seed", "node"), F.lit(2))) / 2)
        quota = quota.withColumn("right", (rank > half).cast("int"))
        quota = quota.select("source", "unit", (F.col("node") * 2 + F.col("right")).alias("node"), (F.col("seed") + 1).alias("seed"))
    quota = written(quota, "mix-split")
    return quota.groupBy("source", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))


def fill_up(free: DataFrame, lack: DataFrame) -> DataFrame:
    """(of, filled, of_size): the documents that fill ``lack`` (source, lack), out of ``free`` (of, block,
    draw, key, size, words: equal rows as one). A round takes what fits in permuted order up to
    the first document that doesn't; that one is larger than what is left, so it and its like are
    out of the next round. Rounds end when nothing fits; then the nearest size may go over."""
    slim = free.join(lack, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    # Nothing above twice the lack can bring a source nearer.
    slim = written(slim.filter("words < 2 * lack"), "mix-free")
    before = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("of", "block").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    fit = slim.filter("words <= lack")
    rounds: list[DataFrame] = []
    while True:
        blocks = fit.groupBy("of", "block").agg(F.sum("words").alias("held"), F.first("lack").alias("open"))
        blocks = blocks.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).filter(F.col("before") < F.col("open"))
        blocks = blocks.select(F.col("of").alias("in_of"), F.col("block").alias("nr"), "before", (F.col("before") + F.col("held") <= F.col("open")).alias("whole"))
        met = fit.join(blocks, F.col("of").eqNullSafe(F.col("in_of")) & (F.col("block") == F.col("nr")), "left").drop("in_of", "nr")
        edge = met.filter("not whole").withColumn("picked", F.col("before") + F.sum("words").over(inside) <= F.col("lack"))
        rest = met.filter("whole is null or whole").withColumn("picked", F.col("whole").isNotNull())
        step = written(rest.unionByName(edge).drop("before", "whole"), "mix-fills")
        picked = step.filter("picked")
        if picked.isEmpty():
            break
        rounds.append(picked.select("of", "key", "size", "words"))
        left = step.groupBy(F.col("of").alias("in_of")).agg((F.first("lack") - F.sum(F.when(F.col("picked"), F.col("words")).otherwise(0))).alias("left"))
        fit = step.filter("not picked").join(left, F.col("of").eqNullSafe(F.col("in_of"))).filter(F.col("words") <= F.col("left"))
        fit = fit.select("of", "block", "draw", "key", "size", "words", F.col("left").alias("lack"))
    taken = reduce(DataFrame.unionByName, rounds, slim.limit(0).select("of", "key", "size", "words"))
    sums = taken.groupBy(F.col("of").alias("in_of")).agg(F.sum("words").alias("got"))
    left = slim.join(sums, F.col("of").eqNullSafe(F.col("in_of")), "left").withColumn("left", F.col("lack") - F.coalesce("got", F.lit(0))).drop("in_of")
    done = taken.select(F.col("of").alias("in_of"), F.col("key").alias("nr"), F.col("size").alias("in_size"))
    left = left.filter("words < 2 * left").join(done, F.col("of").eqNullSafe(F.col("in_of")) & F.col("key").eqNullSafe(F.col("nr")) & (F.col("size") == F.col("in_size")), "left_anti")
    near = left.groupBy("of").agg(F.min(F.struct(F.abs(F.col("words") - F.col("left")).alias("off"), "key", "size")).alias("best"))
    fills = taken.select("of", "key", "size").unionByName(near.select("of", "best.key", "best.size"))
    return written(fills.select("of", F.col("key").alias("filled"), F.col("size").alias("of_size")), "mix-filled")


def mix_sources(documents: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, source, source_size, target, taken, shards): one row per row of
    ``documents``; ``shards`` has a (shard, place) for each copy taken, where ascending ``place``
    is the order inside the shard."""
    slim = documents.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    slim = slim.withColumn("draw", uniform("key", "source")).withColumn("block", F.floor(F.col("draw") * BLOCKS).cast("int"))
    slim = written(slim, "mix-sizes")

    per_block = slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
    per_block = written(per_block, "mix-blocks")
    goal = written(targets(per_block.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-targets")

    # Blocks in permuted order: a pass takes all; the rest takes blocks until the quota is met.
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    plan = per_block.join(goal, per_block["source"].eqNullSafe(goal["source"])).select(per_block["source"], "block", "words", "source_size", "target")
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    plan = plan.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = plan.withColumn("more", F.when(F.col("rest") < 0.5, 0).when(F.col("before") + F.col("words") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.col("passes") + (F.col("more") > 0).cast("int")).otherwise(0))

    # Every copy of a block is a unit. Leaves take units at their offsets in permuted order.
    units = plan.filter("copies > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    shuffled = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED), "source", "block", "copy"), "block", "copy")
    units = units.withColumn("rank", F.row_number().over(shuffled).cast("long"))
    quotas = units.groupBy("source").agg(F.count("*").cast("int").alias("blocks"))
    leaves = split_tree(quotas)
    offset = F.coalesce(F.sum("quota").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = leaves.withColumn("offset", offset).select(F.col("source").alias("of"), "shard", F.explode(F.sequence(F.col("offset") + 1, F.col("offset") + F.col("quota"))).alias("at"))
    placed = units.join(slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("at")))
    placed = placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("copies_in"))
    blocks = plan.select("source", "block", "source_size", "target", "passes", "rest", "before", "more", "copies")
    blocks = blocks.join(placed.select(F.col("source").alias("of"), F.col("block").alias("nr"), "copies_in"), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nr")), "left").drop("of", "nr")
    blocks = written(blocks, "mix-plan").select(F.col("source").alias("of"), F.col("block").alias("nr"), "source_size", "target", "passes", "rest", "before", "more", "copies_in")

    docs = slim.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nr")))
    # Only documents of the one edge block of a source need places within their block.
    edge = docs.filter("more = 1").drop("of", "nr")
    inside = Window.partitionBy("source", "block").orderBy("draw", "key", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("drawn", F.col("before") + F.sum("size").over(inside) <= F.col("rest"))
    sure = docs.filter("more <> 1").drop("of", "nr").withColumn("drawn", F.col("more") == 2)
    out = written(sure.unionByName(edge), "mix-drawn")

    lack = out.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("lack"))
    lack = written(lack.filter("lack >= 1"), "mix-lack")
    free = out.filter("not drawn and size > 0").groupBy(F.col("source").alias("of"), "block", "draw", "key", "size").agg((F.count("*") * F.col("size")).alias("words"))
    fills = fill_up(free, lack)
    out = out.join(fills, F.col("source").eqNullSafe(F.col("of")) & F.col("key").eqNullSafe(F.col("filled")) & (F.col("size") == F.col("of_size")) & ~F.col("drawn"), "left")
    filled = F.col("of_size").isNotNull()

    copies = F.when(F.col("source_size") > 0, F.col("passes") + (F.col("drawn") | filled).cast("int")).otherwise(0)
    none = F.array().cast("array<struct<copy:int,shard:int>>")
    # A fill from a block without a unit of its own goes to a shard by its hash.
    own = F.array(F.struct((F.col("passes") + 1).alias("copy"), F.floor(uniform("key", "size") * (1 << LEVELS)).cast("int").alias("shard")))
    shards = F.transform(
        F.slice(F.concat(F.coalesce("copies_in", none), F.when(filled, own).otherwise(none)), F.lit(1), copies),
        lambda c: F.struct(c["shard"].alias("shard"), uniform("key", c["shard"], c["copy"]).alias("place")),
    )
    return out.select(F.col("key").alias(key), "size", "source", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), shards.alias("shards"))


def mixed(documents: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``documents`` and size, source_size, target, taken and shards; a document that the mix
    leaves out has taken 0 and no shards. Columns of these names are replaced."""
    made = ["size", "source_size", "target", "taken", "shards"]
    of = next(p for p in ("of_" + "_" * i for i in range(99)) if not any(c.lower().startswith(p) for c in documents.columns))
    plan = mix_sources(documents, source, text, key)
    plan = plan.select(F.col(key).alias(of + "key"), F.col(source).alias(of + "source"), *(F.col(c).alias(of + c) for c in made)).dropDuplicates([of + "key", of + "source", of + "size"])
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    same = F.col(key).eqNullSafe(F.col(of + "key")) & F.col(source).cast("string").eqNullSafe(F.col(of + "source")) & (size == F.col(of + "size"))
    kept = [c for c in documents.columns if c not in made]
    return documents.join(plan, same).select(*kept, *(F.col(of + c).alias(c) for c in made))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, whole texts."""
    rows = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", F.size("shards").cast("long").alias("copies"))
