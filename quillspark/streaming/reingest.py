"""Re-indexing a vault as its files change: a stream of whole files, each batch written over the notes that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import notes, retrieval
from ..operators.store import ChunkTable


def changed_notes(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """(source_rel, raw) of files below root as they appear or change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)  # relative roots and such with a scheme come as whole paths in a file's metadata
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(path).toUri().getPath().rstrip("/")
    rows = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", per_batch).text(root, wholetext=True)
    place = F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B"))
    return rows.select(t.relative_path(place, base).alias("source_rel"), t.read_text(F.col("value")).alias("raw"))


def write_batch(table: ChunkTable, batch: DataFrame) -> None:
    """Replace all chunks of the notes in a batch. A batch that is run again gives the same table."""
    latest = batch.groupBy("source_rel").agg(F.max("raw").alias("raw"))
    rows = retrieval.embedded(notes.chunks(notes.parse_notes(latest)), "text").withColumn("heading_path", F.array_join("heading_path", " > "))
    others = table.read().join(latest.select("source_rel"), "source_rel", "left_anti")
    names = table.read().columns
    table.rebuild(others.select(*names).unionByName(rows.select(*names)))


def start(spark: SparkSession, root: str, table: ChunkTable, checkpoint: str) -> StreamingQuery:
    """Index what is there and then stop (start it again to go on, or give the returned query's writer another trigger)."""
    writer = changed_notes(spark, root).writeStream.foreachBatch(lambda batch, _: write_batch(table, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
