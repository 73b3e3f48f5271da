"""[C1-C9] The commands, as plans over a vault or over its chunk table. Models are functions from DataFrame to DataFrame; the defaults need none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answers, claims, clusters, links, notes, pairs, retrieval
from ..operators.store import ChunkTable
from ..sources.vault import read_gaps, read_vault


def check_sample(n: int | None) -> int | None:
    """[P15] A cap on calls of a model; negative ones make no sense."""
    if n is not None and n < 0:
        raise ValueError("a sample cannot be negative")
    return n


def sampled(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    return rows if check_sample(n) is None else rows.orderBy(*order).limit(n)


def ingest(spark: SparkSession, root: str, table: ChunkTable, embed: Callable = retrieval.embedded, count: Callable[[str], int] = notes.count_tokens) -> DataFrame:
    """[C1] Read, cut, embed and store a vault anew; the counters. embed and count take a model's vectors (V1) and a vocabulary's token count (F9)."""
    parsed = notes.frontmatter_maps(notes.parse_notes(read_vault(spark, root)))
    chunks = notes.chunks(parsed, count=count)
    rows = embed(chunks, "text", "vector").withColumn("heading_path", F.array_join("heading_path", " > "))
    table.rebuild(rows)
    return notes.ingest_report(parsed, table.read())


def query(spark: SparkSession, table: ChunkTable, text: str, mode: str = "rerank", k: int = retrieval.TOP, **models) -> DataFrame:
    """[C2] The best chunks for a question. models: embed, prefix and score of retrieval.search()."""
    asked = spark.createDataFrame([(0, text)], "query_id long, query string")
    found = retrieval.search(table.read().select("chunk_id", "text"), asked, "chunk_id", mode=mode, k=k, **models)
    return found.join(table.read().select("chunk_id", "source_rel", "heading_path", "text"), "chunk_id").drop("query_id").orderBy("rank")


def audit(spark: SparkSession, root: str, only: tuple[str, ...] = ("broken", "one-way", "orphan", "shadowed")) -> DataFrame:
    """[C3]"""
    return links.audit(notes.parse_notes(read_vault(spark, root)), only)


def contradict(table: ChunkTable, judge: Callable[[DataFrame], DataFrame] = pairs.mock_judge, k: int = pairs.NEIGHBOURS, min_score: float = 0.5, scope: str | None = None, sample: int | None = None) -> DataFrame:
    """[C4] Pairs of passages of different notes that the judge finds to conflict. The judge sees a, b, a_text, b_text."""
    rows = table.read().where(F.col("vector").isNotNull())
    found = pairs.candidate_pairs(pairs.neighbours(rows, "chunk_id", k=k), rows, "chunk_id", "source_rel")
    few = sampled(found, sample, "a", "b")
    text = lambda x: rows.select(F.col("chunk_id").alias(x), F.col("text").alias(f"{x}_text"))
    return pairs.contradictions(pairs.coherent(judge(few.join(text("a"), "a").join(text("b"), "b"))), min_score, scope).orderBy("a", "b")


def gap(table: ChunkTable, generate: Callable[[DataFrame], DataFrame] = clusters.mock_gaps, min_size: int = clusters.MIN_SIZE, limit: int = clusters.MAX_CLUSTERS, sample: int | None = None) -> DataFrame:
    """[C5] Gaps that the generator proposes for clusters of chunks."""
    found = clusters.clusters(clusters.kmeans(table.read()), "chunk_id", min_size, limit)
    few = found if not check_sample(sample) else found.limit(sample)
    return generate(few).where(t.is_kebab(F.col("suggested_note_title")) & (F.col("gap_question") != ""))


def answer(spark: SparkSession, table: ChunkTable, gaps_path: str, k: int = answers.TOP, min_supporting: int = answers.MIN_SUPPORT, sample: int | None = None, draft: Callable = answers.mock_draft) -> DataFrame:
    """[C6] A stub for each gap: evidence, draft, attribution and strength."""
    gaps = sampled(read_gaps(spark, gaps_path), sample, "query_id")
    rows = table.read().select("chunk_id", "source_rel", "text")
    hits = retrieval.search(rows.select("chunk_id", "text"), gaps.select("query_id", F.col("gap_question").alias("query")), "chunk_id", mode="rerank", k=k)
    hints = gaps.select("query_id", F.posexplode("supporting_chunk_ids").alias("place", "chunk_id"))
    found = answers.evidence(hits, hints, rows, "chunk_id", k).join(rows, "chunk_id")
    best = found.groupBy("query_id").agg(F.min(F.struct("rank", "chunk_id", "text")).alias("first"), F.sort_array(F.collect_set("chunk_id")).alias("retrieved"))
    both = gaps.join(best, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    enough = F.size("retrieved") >= min_supporting
    body = answers.fallback_draft(draft(F.col("gap_question"), F.when(enough, F.col("first.chunk_id")), F.col("first.text")), F.col("gap_question"))
    drafted = answers.attribution(both.withColumn("body", body))
    clean = (F.size("orphan_footnotes") == 0) & (F.size("invalid_refs") == 0)
    return drafted.withColumn("evidence_strength", answers.strength(F.size("retrieved"), clean, F.col("attribution_rate"), min_supporting)).drop("first")


def drift(history: DataFrame, judge: Callable[[DataFrame], DataFrame] = claims.mock_drift, low: float = claims.ALIGNED, high: float = claims.IDENTICAL, granularity: str = "sentence", min_score: int = claims.MIN_DRIFT, sample: int | None = None) -> DataFrame:
    """[C7] Changes of position between revisions (rel_path, seq, content) of notes."""
    return claims.drift_events(judge(sampled(drift_pairs(history, low, high, granularity), sample, "rel_path", "seq", "before_index")), min_score)


def drift_pairs(history: DataFrame, low: float = claims.ALIGNED, high: float = claims.IDENTICAL, granularity: str = "sentence") -> DataFrame:
    """Aligned claims of revisions that follow each other, without noise."""
    steps = claims.adjacent(history)
    side = lambda c: retrieval.embedded(claims.claims(steps.select("rel_path", "seq", F.col(c).alias("content")), ["rel_path", "seq"], granularity=granularity).drop("context"), "claim")
    aligned = claims.align(side("before"), side("after"), ["rel_path", "seq"], low=low, high=high)
    return aligned.where(~claims.is_noise(F.col("before_claim"), F.col("after_claim")))


def concepts(table: ChunkTable, propose: Callable[[DataFrame], DataFrame] = clusters.mock_concept, min_size: int = clusters.MIN_SIZE, limit: int = 20, absence: float = clusters.ABSENCE, k: int = 10) -> DataFrame:
    """[C8] Terms for clusters that hardly any chunk uses."""
    members = clusters.kmeans(table.read())
    proposals = propose(clusters.clusters(members, "chunk_id", min_size, limit)).where(clusters.is_named(F.col("term")))
    found = clusters.absent_terms(table.read(), proposals, absence=absence, k=k)
    return found.join(clusters.concept_evidence(members, "source_rel", "chunk_id"), "cluster_id").orderBy(F.desc("confidence"), "cluster_id")


def confidence(spark: SparkSession, root: str, classify: Callable[[DataFrame], DataFrame] = claims.mock_confidence, only: str | None = None, threshold: int = 2, min_confidence: float = 0.0, sample: int | None = None) -> DataFrame:
    """[C9] Claims that are hardly sure."""
    rows = claims.claims(claims.select_notes(read_vault(spark, root), only), ["source_rel"], "raw")
    return claims.tentative(classify(sampled(rows, sample, "source_rel", "sentence_index")), threshold, min_confidence)
