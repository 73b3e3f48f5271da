"""The registered queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, chat, gbdt, ivfpq, langid, licenses, minhash, mixing, nra, token_store
from .common import prepare, remainder

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
QUALITY_FLOOR = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_store.write(docs, public_tokenizers.path(WORD_TOKENIZER))
    return token_store.checksums(token_store.documents(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def chat_log(turns: DataFrame) -> DataFrame:
    """A log of events for finished turns (conv_id, turn, role, text), each row a message of its own: rows of one turn are told apart by their order of role and text.

    An assistant's message comes as a draft, its regeneration and two streamed deltas; any other as a first half that an edit replaces by the whole.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    half, text = F.floor(F.length("text") / 2).cast("int"), F.coalesce("text", F.lit(""))
    event = lambda seq, kind, said: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    answer = F.array(event(0, "message", F.lit("(draft)")), event(1, "regenerate", F.lit(None).cast("string")), event(2, "delta", first), event(3, "delta", rest))
    other = F.array(event(0, "message", first), event(1, "edit", text))
    rows = turns.select("conv_id", F.struct("turn", copy.alias("copy")).alias("turn"), "role", text.alias("text"))
    return rows.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "assistant", answer).otherwise(other)).alias("e")).select("conv_id", "turn", "role", "e.*")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).selectExpr("-7L AS conv_id", "inline(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role)))").withColumn("text", F.lit(said))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.parse(chat.format_chats(chat_log(turns)))
    loss = F.array_join(F.transform(F.filter("messages", lambda m: m.learn), lambda m: m.text), "")
    spoken = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    return back.select(
        F.col("conversation").alias("conv_id"), F.size("messages").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    trees = gbdt.learn(docs, labels, where=remainder(F.col("doc_id"), 5) != 0)
    scored = gbdt.score(docs, trees)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_FLOOR).cast("int").alias("predicted"))


def op8_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0, k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs, key="doc_id", where=remainder(F.col("doc_id"), 4) != 2)
    found = langid.predict(docs.drop("lang"), profiles)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("f")).select("doc_id", "f.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_token_files": op2_token_files,
        "op3_chat": op3_chat,
        "op4_minhash": op4_minhash,
        "op5_mixing": op5_mixing,
        "op6_neighbours": op6_neighbours,
        "op7_quality": op7_quality,
        "op8_exact_top": op8_exact_top,
        "op9_language_id": op9_language_id,
        "op10_licenses": op10_licenses,
    }


#: Vectors that take part: not null, no component null or not finite, as long as most.
SQL = {
    "op8_exact_top": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
