"""Vector-store jobs (S3-S8, S11): scan, append, upsert, the float32 codec, JSON
snapshots and index bootstrap. The store is a Spark table ``(id, text, metadata,
embedding)`` or, for the supplied data, ``(vec_id, embedding)``; vectors stay arrays,
bytes appear only at the import/export edge."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.vector import norm
from ..operators.knn import ATTRIBUTES, pack
from .manifest import BucketStore

STORE_SCHEMA = "id string, text string, metadata string, embedding array<float>"


def scan(store: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """S3: the store's rows; metadata is read by the reference and dropped, so it is never
    selected here (column pruning keeps it out of the scan)."""
    return store.select(id_col, "embedding")


def append(store: BucketStore, rows: DataFrame, text_col: str | None = None) -> None:
    """Append embeddings with fresh UUID ids; a row without a segment stores text ''.
    One call is one commit, like the reference's one-transaction batch insert."""
    store.append(rows.select(F.expr("uuid()").alias("id"),
                             (F.coalesce(F.col(text_col), F.lit("")) if text_col else F.lit("")).alias("text"),
                             F.lit(None).cast("string").alias("metadata"),
                             F.col("embedding").cast("array<float>").alias("embedding")))


def last_of_batch(batch: DataFrame, id_col: str = "id", arrival: str | None = None) -> DataFrame:
    """Of rows with one id the last by ``arrival`` (a grouped ``max_by``, combined map-side), or
    without that column the greatest row, so the result is defined."""
    others = [c for c in batch.columns if c != id_col]
    last = F.col(arrival) if arrival else F.struct(*others)
    return (batch.groupBy(id_col).agg(F.max_by(F.struct(*others), last).alias("__w"))
            .select(id_col, *[F.col(f"__w.{c}").alias(c) for c in others]))


def upsert(existing: DataFrame, new: DataFrame, id_col: str = "id", arrival: str | None = None) -> DataFrame:
    """S5 over tables: INSERT OR REPLACE by id, as a frame. The store is only filtered against the
    ids of the (small) batch. ``BucketStore.upsert`` is the written form."""
    others = [c for c in existing.columns if c != id_col]
    batch = last_of_batch(new, id_col, arrival)
    kept = existing.join(batch.select(id_col), id_col, "left_anti")
    return (kept.withColumn("batch", F.lit(0)).unionByName(batch.select(id_col, *others).withColumn("batch", F.lit(1)))
            .select(id_col, *others, "batch"))


# ---------------------------------------------------------------------------
# S6 codec: float[] <-> little-endian float32 bytes, whole Arrow batches at a time
# ---------------------------------------------------------------------------

def _encode(batches):
    """list<float> column -> binary column: the flat float32 buffer re-sliced by offsets x 4."""
    import numpy as np
    import pyarrow as pa
    for rb in batches:
        i = rb.schema.get_field_index("embedding")
        col = rb.column(i)
        offsets = col.offsets.to_numpy()
        flat = col.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy(zero_copy_only=False).astype("<f4", copy=False).tobytes()
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(col),
                                           [col.is_valid().buffers()[1] if col.null_count else None,
                                            pa.py_buffer(((offsets - offsets[0]) * 4).astype(np.int32).tobytes()),
                                            pa.py_buffer(flat)], null_count=col.null_count)
        yield pa.RecordBatch.from_arrays([c for j, c in enumerate(rb.columns) if j != i] + [blob],
                                         names=[n for j, n in enumerate(rb.schema.names) if j != i] + ["blob"])


def _decode(batches):
    """binary column -> list<float>; a ragged tail (length % 4) is dropped per value, as
    in the reference decoder. The data buffer is reinterpreted in place when every value
    is whole; only ragged values need an index gather."""
    import numpy as np
    import pyarrow as pa
    for rb in batches:
        i = rb.schema.get_field_index("blob")
        col = rb.column(i)
        bufs = col.buffers()
        off = np.frombuffer(bufs[1], dtype=np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        diffs = np.diff(off)
        if np.all(diffs % 4 == 0):
            flat = raw[off[0]:off[-1]].view("<f4")
        else:
            keep = diffs // 4 * 4
            idx = np.concatenate([np.arange(o, o + k) for o, k in zip(off[:-1], keep)]) if len(keep) else np.zeros(0, int)
            flat = raw[idx].view("<f4")
        list_off = np.concatenate([[0], np.cumsum(diffs // 4)]).astype(np.int32)
        mask = pa.array(~col.is_valid().to_numpy(zero_copy_only=False)) if col.null_count else None
        emb = pa.ListArray.from_arrays(pa.array(list_off, pa.int32()), pa.array(flat, pa.float32()), mask=mask)
        yield pa.RecordBatch.from_arrays([c for j, c in enumerate(rb.columns) if j != i] + [emb],
                                         names=[n for j, n in enumerate(rb.schema.names) if j != i] + ["embedding"])


def encode_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    keep = [c for c in df.columns if c != vec_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vec_col)
    src = df.select(*keep, F.col(vec_col).cast("array<float>").alias("embedding"))
    return src.mapInArrow(_encode, (schema + ", " if schema else "") + "blob binary")


def decode_vectors(df: DataFrame, blob_col: str = "blob") -> DataFrame:
    keep = [c for c in df.columns if c != blob_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != blob_col)
    src = df.select(*keep, F.col(blob_col).alias("blob"))
    return src.mapInArrow(_decode, (schema + ", " if schema else "") + "embedding array<float>")


# ---------------------------------------------------------------------------
# The vector index: unit vectors in blocks, laid out by version
# ---------------------------------------------------------------------------

INDEX_SCHEMA = ("width int, block long, n int, ids array<long>, units array<double>, book_short array<string>, "
                "testament array<int>, version string")


def write_index(vectors: DataFrame, passages: DataFrame, path: str) -> str:
    """Vectors are scaled to length one and packed into blocks once, next to the attributes that
    searches filter by; folders by version, so a search for some versions reads no others.
    Vectors without a passage have a null version."""
    attributes = passages.select("ord", "version", "book_short", "testament")
    blocks = pack(vectors.select("ord", "embedding").join(attributes, "ord", "left"), "ord", "embedding", ["version"], ATTRIBUTES)
    blocks.write.mode("overwrite").partitionBy("version").parquet(path)
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


# ---------------------------------------------------------------------------
# S7 snapshots, S8 bootstrap, S11 build report
# ---------------------------------------------------------------------------

def _absent(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


def save_snapshot(df: DataFrame, uri: str) -> str:
    """S7 save: JSON lines under ``uri`` (the URI scheme picks the file system)."""
    df.write.mode("overwrite").json(uri)
    return uri


def snapshot_exists(spark: SparkSession, uri: str) -> bool:
    """S7 exists: a snapshot is there when its folder holds at least one row."""
    try:
        return not spark.read.text(uri).isEmpty()   # lines, so no schema is inferred
    except AnalysisException as e:
        if not _absent(e):
            raise
        return False


def delete_snapshot(spark: SparkSession, uri: str, schema: str) -> None:
    """S7 delete, as an overwrite with no rows (the same call on any file system)."""
    spark.createDataFrame([], schema).write.mode("overwrite").json(uri)


def load_snapshot(spark: SparkSession, uri: str, schema: str) -> DataFrame | None:
    """S7 load: None (logged, not thrown) when the snapshot is absent."""
    try:
        return spark.read.schema(schema).json(uri)
    except AnalysisException as e:
        if not _absent(e):
            raise
        logging.getLogger(__name__).warning("snapshot %s is absent", uri)
        return None


def load_or_build_index(spark: SparkSession, store_path: str | None, snapshot_uri: str | None,
                        schema: str, build) -> tuple[str, DataFrame]:
    """First non-empty of vector store -> snapshot -> ``build()``; returns the source."""
    for name, path, reader in (("store", store_path, lambda p: spark.read.schema(schema).parquet(p)),
                               ("snapshot", snapshot_uri, lambda p: spark.read.schema(schema).json(p))):
        if not path:
            continue
        try:
            df = reader(path)
            if not df.isEmpty():
                return name, df
        except AnalysisException as e:
            if not _absent(e):
                raise
    made = build()
    if not store_path:
        return "generated", made
    made.write.mode("overwrite").parquet(store_path)   # so the next start finds it
    return "generated", spark.read.schema(schema).parquet(store_path)


def vector_summary(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return df.select(id_col, F.size("embedding").alias("dim"), F.round(norm("embedding"), 6).alias("norm"))


def build_report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Passages and text volume of an index build."""
    return docs.agg(F.count(F.lit(1)).alias("n_passages"),
                    F.sum(F.octet_length(text_col)).cast("long").alias("text_bytes"),
                    F.sum(F.length(text_col)).cast("long").alias("text_chars"))
