"""Structured Streaming forms.

The reference answers requests one at a time; there are no windows, watermarks or
cross-request state. So:

* T1 ``classify_stream``: a stateless streaming projection over a query log: keyword
  extraction (C2), scope split (C5) and scope resolution (C6) are per-row expressions
  with the fixed-size dictionaries inlined, so a streaming frame runs exactly the batch
  plan.
* T2 ``search_stream``: ``foreachBatch`` runs the routed search (E4) on each
  micro-batch of queries. Top-k is per query, so no state crosses batches; Spark rejects
  a ``row_number`` window directly on a streaming frame, which ``foreachBatch`` avoids.
  Each batch commits its rows to an ``EpochSink``: an epoch that runs again after a failure
  replaces its first output, and a batch that dies half-way leaves nothing that is read.

Both use checkpoints under the shared checkpoint folder and ``trigger(availableNow=True)``
so a run processes what is there and stops."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import java_trim
from ..operators import classify as C
from ..operators.classify import centroid_literals, prototype_centroids
from ..plans import search as S
from ..session import scratch_path
from ..sources.dictionaries import Dictionaries
from ..sources.manifest import EpochSink

RESULT_SCHEMA = ("qid long, rank int, key string, reference string, book_name string, book_short string, "
                 "chapter int, verse int, title string, text string, version string, score double, "
                 "reranked_score double, search_method string")


def classify_log(df: DataFrame, dicts: Dictionaries, text_col: str = "text") -> DataFrame:
    """T1 body (batch or stream): per-row keyword and scope of each logged query."""
    groups, names = C.dictionary_columns(dicts)
    q = df.withColumn("trimmed", java_trim(text_col))
    q = C.split_scope(q)
    ko = C.resolve_scope(F.col("ko_scope"), F.lit("ko"), groups, names)
    en = C.resolve_scope(F.col("en_scope"), F.lit("en"), groups, names)
    r = F.coalesce(ko, en)
    return q.select(*[c for c in df.columns if c != text_col],
                    C.extract_keyword(F.col("trimmed"), dicts.stop_words).alias("keyword"),
                    "ko_scope", "en_scope",
                    F.coalesce(r["scope_type"], F.lit("NONE")).alias("scope_type"),
                    F.array_join(r["scope_books"], ",").alias("scope_books"),
                    r["scope_testament"].alias("scope_testament"))


def classify_stream(spark: SparkSession, source_glob: str, schema: str, dicts: Dictionaries,
                    text_col: str = "text") -> DataFrame:
    """Run T1 over the files matching ``source_glob`` and return the sink's rows."""
    out, ckpt = scratch_path(spark, "t1-out"), scratch_path(spark, "t1-ckpt")
    stream = spark.readStream.schema(schema).parquet(source_glob)
    q = (classify_log(stream, dicts, text_col).writeStream.format("parquet")
         .option("checkpointLocation", ckpt).option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


QUERY_SCHEMA = "qid long, query string, max_results int, min_score double, version string"


def search_stream(spark: SparkSession, source_glob: str, schema: str, inputs: S.SearchInputs,
                  query_vectors: DataFrame, files_per_batch: int | None = None, sink: EpochSink | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """Run T2: every micro-batch of ``(qid, query, max_results, min_score, version)``
    rows is answered by the routed search; returns all committed results."""
    sink = sink or EpochSink(spark, scratch_path(spark, "t2-out"), RESULT_SCHEMA)
    centroids = centroid_literals(prototype_centroids(inputs.prototypes))   # once, not per batch

    def answer(batch: DataFrame, epoch: int) -> None:
        inp = dataclasses.replace(inputs, queries=batch.join(query_vectors, "qid", "left"))
        ctx = S.query_context(inp, centroids)
        sink.write(S.routed_search(inp, ctx), epoch)
        ctx.unpersist()

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(source_glob).writeStream.foreachBatch(answer)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "t2-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink.read()
