"""Connected components of a table of links, by contraction on Spark.

Every round hooks each vertex to its smallest neighbour, follows the hooks twice, and rewrites
the links between the hooked vertices. A round at least halves the vertices that still have
links, so the rounds grow with the logarithm of the longest chain. Every round's hooks are
written under the shared checkpoint folder; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.session import scratch_path


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back: cuts the lineage, and a
    lost executor costs no earlier work."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for all vertices of ``links`` (a, b: long): the component is the
    smallest vertex that links reach. Direction, loops and repeats don't matter; null ends are
    dropped; no links give no rows."""
    cut = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = written(cut.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    layers: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("root"))
        hook = written(hook, "hooks")
        up = hook.select(F.col("v").alias("root"), F.col("root").alias("above"))
        hook = written(hook.join(up, "root").select("v", F.col("above").alias("root")), "hooks")
        layers.append(hook)
        left = hook.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").filter("ra <> rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not layers:
        return cut.select(F.col("a").alias("vertex"), F.col("b").alias("component")).limit(0)
    # A vertex that hooks to itself or stays without links keeps its root in later layers.
    out = layers[0].withColumnRenamed("root", "component")
    for layer in layers[1:]:
        after = layer.select(F.col("v").alias("component"), F.col("root").alias("next"))
        out = out.join(after, "component", "left").select("v", F.coalesce("next", "component").alias("component"))
    return out.withColumnRenamed("v", "vertex")
