"""The chunk table [S10-S13, K1, K2] as Parquet with a fixed schema."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = r"^[A-Za-z0-9_\-]{1,64}$"
SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("source_rel", T.StringType()), T.StructField("heading_path", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType())),
])


class Store(Protocol):
    """[V24] What a store offers."""

    def upsert(self, rows: DataFrame) -> int: ...
    def read(self) -> DataFrame: ...
    def count(self) -> int: ...


def merge(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """[K1] existing without the rows that new replaces, and new (of several new rows with one key the largest stays)."""
    own = [c for c in new.columns if c != key]
    latest = new.groupBy(key).agg(F.max(F.struct(*own)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in own)).select(*new.columns)
    return existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(latest)


class ChunkTable:
    """A folder with a subfolder for each version: a write makes the next one, so a reader never sees half of one. The KEPT versions before it stay for those that still read them."""

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        done = [p.getName() for p in names if self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if n.startswith("v"))

    def read(self) -> DataFrame:
        """[S11, S12] Every chunk; an empty table where none was written."""
        versions = self._versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{versions[-1]}") if versions else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        versions = self._versions()
        rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA)).write.mode("overwrite").parquet(f"{self.path}/v{(versions or [0])[-1] + 1}")
        for v in versions[: -self.KEPT]:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)

    def upsert(self, rows: DataFrame) -> int:
        """[K1] Write rows over those with their ids; the number of rows written. An id that is no id raises ValueError."""
        bad = rows.where(~F.col("chunk_id").rlike(ID) | F.col("chunk_id").isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"not a chunk id: {bad[0]['chunk_id']!r}")
        self._write(merge(self.read(), rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA)), "chunk_id"))
        return rows.select("chunk_id").distinct().count()

    def rebuild(self, rows: DataFrame) -> int:
        """[K2] Write rows in place of all others."""
        self._write(rows)
        return self.count()

    def reset(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))

    def count(self) -> int:
        """[S13]"""
        return self.read().count()


def split_headings(rows: DataFrame) -> DataFrame:
    """[P17] Rows with the heading path as a list again; a null score is 0."""
    out = rows.withColumn("heading_path", F.filter(F.split("heading_path", " > "), lambda h: h != ""))
    return out.withColumn("score", F.coalesce("score", F.lit(0.0))) if "score" in rows.columns else out
