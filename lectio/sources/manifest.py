"""Tables that are committed by a manifest: readers see a state from before a write or from after it.

Data files are written to folders of their own first; a commit then adds one small Parquet file
to the manifest, which a file system shows whole or not at all. A write that dies leaves folders
that no manifest names. There is one writer at a time; readers need no lock."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def _entries(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _commit(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


class BucketStore:
    """Rows by id, in ``buckets`` folders by a hash of the id (about 256 MB a bucket is a good size).

    ``append`` adds a folder to the buckets that it touches; ``upsert`` rewrites the buckets that
    its batch touches, and no others. Each manifest version names the folders of every bucket: its
    size is the number of buckets, whatever the rows."""

    MANIFEST = "version long, bucket int, folder string"

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, id_col: str = "id", buckets: int = 64):
        self.spark, self.path, self.id_col, self.buckets = spark, path, id_col, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def bucket(self):
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.buckets)).cast("int")

    def _state(self) -> tuple[int, list[tuple[int, str]]]:
        table = _entries(self.spark, f"{self.path}/manifest", self.MANIFEST)
        if table is None:
            return 0, []
        version = table.agg(F.max("version")).first()[0] or 0
        return version, [(r["bucket"], r["folder"]) for r in table.filter(F.col("version") == version).collect() if r["folder"] is not None]

    def _rows(self, places: list[tuple[int, str]]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(f"{folder}/bucket={b}" for b, folder in places))

    def read(self) -> DataFrame:
        return self._rows(self._state()[1])

    def write_data(self, rows: DataFrame) -> list[tuple[int, str]]:
        """Rows to a folder of their own; the buckets that it holds. Nothing is visible yet."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema.fields]
        (rows.select(*names).withColumn("bucket", self.bucket()).repartition("bucket")
         .write.partitionBy("bucket").parquet(folder))
        held = self.spark.read.schema("bucket int").parquet(folder).distinct().collect()
        return [(r["bucket"], folder) for r in held]

    def commit(self, version: int, places: list[tuple[int, str]]) -> None:
        _commit(self.spark, f"{self.path}/manifest", [(version, b, f) for b, f in places] or [(version, None, None)], self.MANIFEST)

    def append(self, rows: DataFrame) -> None:
        version, places = self._state()
        self.commit(version + 1, places + self.write_data(rows))

    def upsert(self, batch: DataFrame, arrival: str | None = None) -> None:
        """INSERT OR REPLACE by id: of a batch's rows with one id the last by ``arrival`` wins (or
        the greatest row), and replaces the store's."""
        from .vectors import last_of_batch
        version, places = self._state()
        last = last_of_batch(batch, self.id_col, arrival)
        touched = {r[0] for r in last.select(self.bucket()).distinct().collect()}
        names = [f.name for f in self.schema.fields]
        kept = self._rows([p for p in places if p[0] in touched]).join(last.select(self.id_col), self.id_col, "left_anti")
        fresh = self.write_data(kept.select(*names).unionByName(last.select(*names)))
        self.commit(version + 1, [p for p in places if p[0] not in touched] + fresh)


class EpochSink:
    """A stream's results: the rows of an epoch that runs again replace those of its first run."""

    MANIFEST = "epoch long, attempt long, folder string"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, rows: DataFrame, epoch: int) -> None:
        folder = f"{self.path}/data/{epoch}-{uuid.uuid4().hex}"
        rows.select(*StructType.fromDDL(self.schema).names).write.parquet(folder)
        done = _entries(self.spark, f"{self.path}/manifest", self.MANIFEST)
        before = done.filter(F.col("epoch") == epoch).count() if done is not None else 0
        _commit(self.spark, f"{self.path}/manifest", [(epoch, before, folder)], self.MANIFEST)

    def read(self) -> DataFrame:
        done = _entries(self.spark, f"{self.path}/manifest", self.MANIFEST)
        if done is None:
            return self.spark.createDataFrame([], self.schema)
        last = done.groupBy("epoch").agg(F.max_by("folder", "attempt").alias("folder")).collect()
        return self.spark.read.schema(self.schema).parquet(*sorted(r["folder"] for r in last))
