"""Registered queries on verdicts, gold data, reports and drafts. Test tables stand in for what a model or a person would give: a verdict follows from a row's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t, verdicts
from ..operators import answers, claims, links, metrics, notes, pairs, reports, store
from . import commands
from .queries import QUERIES, asked, documents, parsed, query, table, turn_claims
from .vault import vault

BODY = f"{answers.SAYS}\n\nSo it is.[^1]\n\n{answers.GAPS}\n\n- none\n\n{answers.RELATED}\n\n{answers.CITED}\n\n[^1]: `c1`\n"


# Verdicts


@query
def contradiction_gate(spark, sf_dir):
    """[P2, P3] Line items as judged pairs: factual contradictions with a score of 0.5 or more."""
    kind = F.element_at(F.array(F.lit("none"), F.lit("factual"), F.lit("temporal")), F.col("l_linenumber") % 3 + 1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") % 2 == 1).alias("verdict"), kind.alias("type"), F.round(F.col("l_discount") * 10, 4).alias("score"))
    return pairs.contradictions(pairs.coherent(rows), 0.5, "factual")


@query
def pair_verdicts_mock(spark, sf_dir):
    """[V7]"""
    return pairs.mock_judge(table(spark, sf_dir, "events").select("event_id"))


@query
def drift_gate(spark, sf_dir):
    """[P4] Events as judged changes: even ones are drift, scored 1 to 5."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("drift"), (F.col("event_id") % 5 + 1).alias("score"))
    return claims.drift_events(rows)


@query
def drift_mock(spark, sf_dir):
    """[V13, V14]"""
    return claims.mock_drift(table(spark, sf_dir, "events").select("event_id"))


def judged_by_cosine(rows):
    """A stand-in for a judge of drift: the less alike two claims, the higher the score."""
    return rows.withColumns({"drift": F.col("cosine") < 0.7, "type": F.lit("reversal"), "score": F.when(F.col("cosine") < 0.5, 5).when(F.col("cosine") < 0.6, 4).otherwise(3)})


@query
def drift_command(spark, sf_dir):
    """[C7] Turns of a conversation as revisions of a note."""
    history = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rel_path"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return commands.drift(history, judge=judged_by_cosine, low=0.3).select("rel_path", "seq", "before_index", "after_index", "score")


@query
def drift_counters(spark, sf_dir):
    """[A11]"""
    rows = turn_claims(spark, sf_dir)
    aligned = claims.align(rows, rows.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"], low=0.3)
    return claims.drift_totals(table(spark, sf_dir, "conversations"), aligned, judged_by_cosine)


@query
def concept_mock(spark, sf_dir):
    """[V15, V16]"""
    from ..operators import clusters

    return clusters.mock_concept(table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id")).distinct())


@query
def json_verdicts(spark, sf_dir):
    """[F30, F20, V23] Fenced answers with levels from 0 to 6, of which those out of bounds count as abstentions, and every eleventh, which is cut short."""
    whole = F.concat(F.lit('```json\n{"level": '), (F.col("o_orderkey") % 7).cast("string"), F.lit(', "rationale": "by number", "confidence": 0.5}\n```'))
    answer = F.when(F.col("o_orderkey") % 11 == 0, F.substring(whole, 1, 30)).otherwise(whole)
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(verdicts.parsed(answer, "confidence"), verdicts.neutral("confidence")).alias("v"))
    return found.select("o_orderkey", F.col("v.level").alias("level"), F.col("v.rationale").alias("rationale"), F.col("v.confidence").alias("confidence"))


@query
def verdict_prompts(spark, sf_dir):
    """[F31, F19]"""
    return asked(spark, sf_dir).select("query_id", verdicts.prompt("Is <q>{question}</q> of {set} {other}?", {"question": F.col("query"), "set": F.lit("a < b")}).alias("prompt"))


@query
def verdict_retries(spark, sf_dir):
    """[V23] A model that answers every third prompt at once, every other third if told to be strict, and else never as JSON."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    first = F.concat(F.lit("rate "), (F.col("o_orderkey") % 3).cast("string"))
    model = lambda p: F.when(p.isNotNull(), F.when(p.isin("rate 0", "strict 1"), F.lit('{"score": 4, "reasoning": "yes"}')).otherwise("well, 4"))
    found = verdicts.asked(rows, [first, F.replace(first, F.lit("rate"), F.lit("strict"))], model, "match")
    return found.select("o_orderkey", "abstained", F.col("verdict.score").alias("score"), F.col("verdict.reasoning").alias("reasoning"))


# Gold data


@query
def gold_pair_lookup(spark, sf_dir):
    """[J20] Pairs of a part and a supplier by number of line items; the gold pairs are those of first lines, the other way round."""
    items = table(spark, sf_dir, "lineitem")
    found = items.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"))
    return metrics.gold_pairs(found.where("n > 1"), items.where("l_linenumber = 1").select(F.col("l_partkey").alias("chunk_a_id"), F.col("l_suppkey").alias("chunk_b_id")).distinct()).fillna(0, ["n"])


@query
def greedy_assignment(spark, sf_dir):
    """[J21] Nations in order each claim a region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    scores = nation.select(F.col("n_name").alias("proposal_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey"), "n_nationkey").join(region, "r_regionkey")
    scores = scores.select("proposal_id", F.col("r_name").alias("gold_id"), ((F.col("n_nationkey") * 3 + F.col("r_regionkey") * 2) % 6).alias("score"))
    return metrics.greedy_match(nation.select(F.col("n_name").alias("proposal_id"), F.col("n_nationkey").alias("place")), scores)


@query
def drift_gold_match(spark, sf_dir):
    """[J22] Parts as events of their brand's note, every fifth as gold."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("before_claim"), F.col("p_type").alias("after_claim"))
    note = lambda folder: F.concat(F.lit(folder), "p_brand", F.lit(".md")).alias("note")
    return metrics.drift_matches(p.select(note("a/"), F.col("p_partkey").alias("event_id"), "before_claim", "after_claim"), p.where("p_partkey % 5 = 0").select(note("b/c/"), F.col("p_partkey").alias("id"), "before_claim", "after_claim"))


@query
def concept_gold_match(spark, sf_dir):
    """[J23, F32] Part names as concepts of their brand's note, every seventh part's name with its type as gold."""
    p = table(spark, sf_dir, "part")
    found = p.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("term"), F.array("p_brand").alias("notes"))
    gold = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type").alias("canonical_term"), F.array("p_brand", F.lit("other")).alias("supporting_notes"))
    return metrics.concept_matches(found, gold)


@query
def claim_gold_match(spark, sf_dir):
    """[J24, F32] A user's events as claims of a note, every tenth as gold, a little further on."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("note"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + 20 + F.col("event_id") % 7).alias("stop"), "event_type")
    gold = e.where("event_id % 10 = 0").select("note", F.col("event_id").alias("id"), (F.col("start") + F.col("event_id") % 13).alias("start"), F.col("stop"), F.upper("event_type").alias("claim_text"))
    return metrics.claim_matches(e.select("note", F.col("event_id").alias("claim_id"), "start", "stop", F.concat("event_type", F.lit("!")).alias("claim")), gold)


@query
def class_metrics(spark, sf_dir):
    """[A22]"""
    return metrics.precision_recall(table(spark, sf_dir, "lineitem"), F.col("l_tax") > 0.04, F.col("l_discount") > 0.05, ["l_returnflag"])


@query
def borderline_matches(spark, sf_dir):
    """[K15]"""
    return reports.borderline(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5 + 1).alias("score")))


# Reports


def unsure(spark, sf_dir):
    return claims.tentative(claims.mock_confidence(claims.claims(vault(spark, sf_dir), ["source_rel"], "raw")))


@query
def findings_by_note(spark, sf_dir):
    """[A12]"""
    return claims.findings_per_note(unsure(spark, sf_dir), "source_rel")


@query
def findings_markdown(spark, sf_dir):
    """[K5, K6, K8-K10]"""
    return reports.grouped_markdown(unsure(spark, sf_dir), "Unsure claims", "source_rel", ["sentence_index"], F.col("claim"))


@query
def findings_json(spark, sf_dir):
    """[K4-K6, K8-K10]"""
    return reports.as_json(unsure(spark, sf_dir).select("source_rel", "sentence_index", "claim", "level"), ["source_rel", "sentence_index"], threshold=2)


@query
def answers_json(spark, sf_dir):
    """[K7] Attribution of drafts, rates to four places."""
    rows = answers.attribution(drafted(spark, sf_dir)).select("n_nationkey", "total_sentences", "cited_sentences", (F.col("attribution_rate") / 3).alias("rate"))
    return reports.answer_json(rows, "n_nationkey", k=8)


@query
def query_text(spark, sf_dir):
    """[K11] The first passages' documents by number as ranked results."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    ranked = asked(spark, sf_dir).select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).select("query_id", "rank", (F.col("query_id") + F.col("rank")).alias("doc_id"), (1 / F.col("rank")).alias("score"))
    return reports.results_text(ranked, docs, "doc_id", "source", "lang", "text")


@query
def audit_classes(spark, sf_dir):
    """[C3, P1, T2]"""
    return links.audit(parsed(spark, sf_dir), ("broken", "shadowed"))


# Drafts and the store


def drafted(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.when(F.col("n_nationkey") % 3 > 0, BODY).otherwise("Nothing.").alias("body"), F.array(F.lit("c1")).alias("retrieved"))


@query
def fallback_drafts(spark, sf_dir):
    """[V12, F26]"""
    return drafted(spark, sf_dir).select("n_nationkey", answers.fallback_draft(F.col("body"), F.col("n_name")).alias("body"))


@query
def stub_render(spark, sf_dir):
    """[K13, F23]"""
    rows = drafted(spark, sf_dir).withColumn("title", F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))))
    names = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.lit("other"))).otherwise(F.array().cast("array<string>"))
    stub = answers.render_stub(F.col("title"), F.concat(F.lit('Is "'), "n_name", F.lit('" one?')), F.col("n_regionkey"), F.lit("thin"), F.col("retrieved"), F.lit(BODY), names, "2024-01-01T00:00:00Z")
    return rows.select("n_nationkey", stub.alias("stub"))


@query
def answers_markdown(spark, sf_dir):
    """[K7]"""
    return reports.answer_markdown(drafted(spark, sf_dir), "n_nationkey")


@query
def cited_notes(spark, sf_dir):
    """[J18] A conversation cites the parts with its turns' numbers; a part is of its brand's note."""
    cited = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.concat(F.lit("c"), (F.col("conv_id") % 50 + F.col("turn")).cast("string")).alias("chunk_id"))
    held = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.concat(F.lit("parts/"), "p_brand", F.lit(".md")).alias("source_rel"))
    return answers.related_notes(cited, held).withColumn("related", F.array_join("related", ", "))


@query
def stored_hits(spark, sf_dir):
    """[P17]"""
    rows = store.split_headings(table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" > "), "p_type").alias("heading_path"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("score")))
    return rows.select("p_partkey", F.size("heading_path").alias("depth"), F.array_join("heading_path", "/").alias("heading_path"), "score")


@query
def selected_notes(spark, sf_dir):
    """[S3, S4]"""
    rows = vault(spark, sf_dir).select("source_rel")
    return claims.select_notes(rows, "C1").unionAll(claims.select_notes(rows, "c2.md", exact=True))


@query
def ingest_counts(spark, sf_dir):
    """[A5] The counters over paragraphs as chunks."""
    found = notes.frontmatter_maps(parsed(spark, sf_dir))
    rows = found.select("source_rel", F.explode(t.paragraphs(F.col("body"))).alias("text")).withColumn("token_count", t.token_count(F.col("text")))
    return notes.ingest_report(found, rows)
