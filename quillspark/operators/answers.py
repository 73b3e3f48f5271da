"""Answers to gaps: evidence, a drafted stub, and whether it cites what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

TOP, MIN_SUPPORT = 8, 2
SAYS, GAPS, RELATED, CITED = "## What the vault says", "## Evidence gaps", "## Related notes", "## Citations"


def evidence(hits: DataFrame, hints: DataFrame, items: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """[J15, U3, W8, T8] (query_id, key, rank, score): retrieved rows, then hinted ones that exist and were not retrieved, with score 0, k in all.

    hits: query_id, key, rank, score; hints: query_id, key, place.
    """
    fresh = hints.join(hits.select("query_id", key), ["query_id", key], "left_anti").join(items.select(key), key, "left_semi").groupBy("query_id", key).agg(F.min("place").alias("place"))
    rows = hits.select("query_id", key, F.lit(0).alias("part"), F.col("rank").cast("long").alias("place"), F.col("score").cast("double").alias("score"))
    rows = rows.unionByName(fresh.select("query_id", key, F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), F.lit(0.0).alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "place", key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "rank", "score")


def strength(supporting: Column, clean: Column, rate: Column, min_supporting: int = MIN_SUPPORT) -> Column:
    """[P14] How well a draft is supported."""
    return F.when(supporting < min_supporting, "external-research").when(~clean | (rate < 0.5), "thin").otherwise("strong")


def mock_draft(question: Column, chunk_id: Column, text: Column) -> Column:
    """[V10, V11] A stub from the first chunk of the evidence, without a model; without a chunk, one that asks for outside sources."""
    line = F.substring(F.replace(t.strip(text), F.lit("\n"), F.lit(" ")), 1, 80)
    cited = F.concat(
        F.lit(SAYS + "\n\nThe vault notes that "), line, F.lit("[^1]\n\n" + GAPS + "\n\n- mock-gap: open in part: "), question,
        F.lit("\n\n" + RELATED + "\n\n" + CITED + "\n\n[^1]: `"), chunk_id, F.lit("` — \""), F.substring(line, 1, 60), F.lit("...\"\n"),
    )
    outside = SAYS + "\n\nNothing in the vault covers this.\n\n" + GAPS + "\n\n- Outside sources are needed.\n\n" + RELATED + "\n\n" + CITED + "\n\n_None: outside sources are needed._\n"
    return F.when(chunk_id.isNull(), F.lit(outside)).otherwise(cited)


def fallback_draft(draft: Column, question: Column) -> Column:
    """[V12, F26] The draft if it has its sections, else a stub that says so."""
    stub = F.concat(F.lit(SAYS + "\n\nNo draft could be made.\n\n" + GAPS + "\n\n- "), question, F.lit("\n\n" + RELATED + "\n\n" + CITED + "\n"))
    return F.when(F.coalesce(t.has_sections(draft), F.lit(False)), draft).otherwise(stub)


def attribution(drafts: DataFrame, draft: str = "body", retrieved: str = "retrieved") -> DataFrame:
    """[V22, J17, U4, A9, F21, F22] drafts with total_sentences, cited_sentences, attribution_rate (1 without sentences), orphan_footnotes and invalid_refs.

    A sentence is a line of the first section that is neither blank nor a footnote; retrieved: the ids that may be cited. A draft with no footnotes at all has no sentences to cite.
    """
    said, defined = t.section_named(F.col(draft), "What the vault says"), t.citations(F.col(draft))
    rows = drafts.withColumn("_said", said).withColumn("_defined", defined)
    lines = F.filter(F.transform(F.split("_said", "\n"), t.strip), lambda x: (x != "") & ~F.startswith(x, F.lit("[^")))
    outside = (F.size("_defined") == 0) & ~F.col(draft).rlike(r"\[\^\d+\]")
    rows = rows.withColumn("_lines", F.when(outside, F.array().cast("array<string>")).otherwise(lines))
    rows = rows.withColumn("total_sentences", F.size("_lines")).withColumn("cited_sentences", F.size(F.filter("_lines", lambda x: x.rlike(r"\[\^\d+\]"))))
    known = F.transform("_defined", lambda d: d.footnote_id)
    rows = rows.withColumn("attribution_rate", F.when(F.col("total_sentences") == 0, 1.0).otherwise(F.round(F.col("cited_sentences") / F.col("total_sentences"), 4)))
    rows = rows.withColumn("orphan_footnotes", F.array_except(t.footnotes_used(F.col("_said")), known))
    bad = F.filter(F.transform("_defined", lambda d: d.chunk_id), lambda c: ~F.array_contains(F.col(retrieved), c))
    return rows.withColumn("invalid_refs", F.array_sort(bad)).drop("_said", "_defined", "_lines")


def related_notes(cited: DataFrame, chunk_notes: DataFrame, key: str = "query_id") -> DataFrame:
    """[J18] The distinct stems of the notes whose chunks are cited, sorted. cited: key, chunk_id; chunk_notes: chunk_id, source_rel."""
    stem = F.regexp_replace(F.substring_index("source_rel", "/", -1), r"\.[^.]*$", "")
    return cited.join(chunk_notes, "chunk_id").groupBy(key).agg(F.sort_array(F.collect_set(stem)).alias("related"))


def render_stub(title: Column, question: Column, cluster_id: Column, level: Column, chunk_ids: Column, body: Column, names: Column, generated_at: str, drafter: str = "mock") -> Column:
    """[K13, F23] A stub file: properties, heading, the gap, the body with its related notes."""
    listed = F.when(F.size(chunk_ids) > 0, F.array_join(F.transform(chunk_ids, lambda c: F.concat(F.lit("  - "), c)), "\n")).otherwise(F.lit("  []"))
    head = F.array_join(F.transform(F.split(F.replace(title, F.lit("-"), F.lit(" ")), " "), lambda w: F.initcap(w)), " ")
    return F.concat(
        F.lit("---\ntitle: "), title, F.lit(f"\ngenerated_by: quillspark-answer\ngenerated_at: {generated_at}\nsource_gap_question: \""), F.replace(question, F.lit('"'), F.lit("'")),
        F.lit("\"\nsource_cluster_id: "), cluster_id.cast("string"), F.lit(f"\ngenerator: {drafter}\nevidence_strength: "), level, F.lit("\nsupporting_chunks:\n"), listed,
        F.lit("\n---\n\n# "), head, F.lit("\n\n> **Gap:** "), question, F.lit("\n\n"), t.inject_related(body, names),
    )


def answer_counts(answers: DataFrame) -> DataFrame:
    """[A10] One row: drafts by strength."""
    return answers.agg(F.count("*").alias("drafts"), *(F.count_if(F.col("evidence_strength") == s).alias(s.replace("-", "_")) for s in ("strong", "thin", "external-research")))
