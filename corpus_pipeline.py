"""A training corpus from raw documents, in stages that each call one operator of quillspark.llm.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. A stage works on every row that its predecessor kept.

- language: rows whose text is null or has no letter (`und`) or is nearest to no profile (score under MIN_LANGUAGE) go.
- quality: rows with a score under MIN_QUALITY go; learned from the labels of the documents that reach the stage.
- near_duplicates: one row of each class of near duplicates stays, the one with the smallest id.
- mixing: sources to the power 0.7 of their size, by a Pfair schedule: rows of under-sized sources recur in further epochs, and rows are
  written in the order of the mix. No row is lost.
- encoding: byte-level BPE ids of each row's text, with a check that they decode to it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, gbdt, langid, minhash, mixing
from quillspark.llm.common import prepare, q, written
from quillspark.llm.queries import BYTE_RANKS, QUALITY_FLOOR

MIN_LANGUAGE, MIN_QUALITY = 0.15, QUALITY_FLOOR


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.learn(docs, key="doc_id"), lang="_quill_lang", score="_quill_score")
    kept = found.where((F.col("_quill_lang") != langid.UNKNOWN) & (F.col("_quill_score") >= MIN_LANGUAGE))
    return kept.select(*(q(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = gbdt.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = gbdt.score(docs, trees, out="_quill_score").where(F.col("_quill_score") >= MIN_QUALITY)
    return kept.select(*(q(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed, rows = mixing.mix_and_length(docs, position="_quill_position", epoch="_quill_epoch")
    return mixing.in_order(mixed, rows, "_quill_position").select(*(q(c) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_RANKS)
    both = bpe.round_trip(docs.select("doc_id", "source", "text"), path)
    return both.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mix), ("encoding", encoding)]

#: Distances between profiles, boosted trees, MinHash and merges are beyond SQL: tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again like any table in the shared folder."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
