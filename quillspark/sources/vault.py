"""Folders of notes, and the JSON documents that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

GAPS = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("vault_root", T.StringType()), T.StructField("generator", T.StringType()),
    T.StructField("findings", T.ArrayType(T.StructType([
        T.StructField("cluster_id", T.IntegerType()), T.StructField("cluster_size", T.IntegerType()), T.StructField("gap_question", T.StringType()), T.StructField("rationale", T.StringType()),
        T.StructField("suggested_note_title", T.StringType()), T.StructField("supporting_chunk_ids", T.ArrayType(T.StringType())),
    ]))),
])


def _pattern(glob: str) -> str:
    """A glob of whole paths as a regular expression: ** spans folders, * and ? do not."""
    out = ""
    for part in glob.replace("**/", "\x00").replace("**", "\x01"):
        out += {"\x00": "(?:.*/)?", "\x01": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.isalnum() or part in "_/-" else "\\" + part)
    return f"^{out}$"


def read_vault(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """[S1, S2, U1, F12, T1] (source_rel, raw): files below root that any of include names and none of exclude.

    The listing and the reading are Spark's, so root may be in any store. FileNotFoundError and NotADirectoryError as the path is missing or a file.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(root)
    base = fs.resolvePath(path).toUri().getPath().rstrip("/")
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    where = F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B"))
    rows = rows.select(t.relative_path(where, base).alias("source_rel"), t.read_text(F.col("value")).alias("raw"))
    wanted = F.lit(False)
    for glob in include:
        wanted = wanted | F.col("source_rel").rlike(_pattern(glob))
    for glob in exclude:
        wanted = wanted & ~F.col("source_rel").rlike(_pattern(glob))
    return rows.where(wanted)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """[S9] A gap report's findings, numbered; ValueError for anything that is no report of version 1."""
    try:
        rows = spark.read.schema(GAPS).option("mode", "FAILFAST").json(path, multiLine=True).collect()
    except Exception as e:
        raise ValueError(f"{path} is no gap report: {str(e).splitlines()[0]}") from e
    if len(rows) != 1 or rows[0].schema_version != 1 or rows[0].findings is None:
        raise ValueError(f"{path} is no gap report of version 1")
    for f in rows[0].findings:
        if not f.gap_question or not f.suggested_note_title or f.supporting_chunk_ids is None:
            raise ValueError(f"{path}: a finding lacks a key")
    kind = T.StructType([T.StructField("query_id", T.LongType()), *GAPS["findings"].dataType.elementType.fields])
    return spark.createDataFrame([(i, *f) for i, f in enumerate(rows[0].findings)], kind)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """[S14] Retrieval queries with their expected titles."""
    return spark.read.schema("id string, difficulty string, query string, expected_titles array<string>").json(path).fillna({"difficulty": "unknown"})


def read_gold(spark: SparkSession, path: str, array: str) -> DataFrame:
    """[S15] One array of a gold document as rows."""
    return spark.read.json(path, multiLine=True).select(F.inline(array))
