"""Reports as text [K4-K11, K14, K15]. A report is assembled from sorted lines, so findings are numbered and joined on the executors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def lines(rows: DataFrame, by: str, order: list[str], line: Column) -> DataFrame:
    """(by, n, block): the number of each group's rows, and a line for each in order."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_all")).select(by, "n", F.array_join(F.transform("_all", lambda x: x["_line"]), "\n").alias("block"))


def audit_markdown(findings: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """[K4] One row: the audit as Markdown, every class with a heading and its count, empty ones saying so."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    arrow = F.when(F.col("detail") == "embed", " ![[...]]").otherwise(" [[...]]")
    text = (
        F.when(F.col("defect") == "broken", F.concat(tick(F.col("source")), F.lit(" → "), tick(F.col("target")), arrow))
        .when(F.col("defect") == "one-way", F.concat(tick(F.col("source")), F.lit(" → "), tick(F.col("target")), F.lit(" (no backlink)")))
        .when(F.col("defect") == "orphan", F.concat(tick(F.col("source")), F.lit(" ("), F.col("detail"), F.lit(" outbound, 0 inbound)")))
        .otherwise(F.concat(tick(F.col("source")), F.lit(" → "), tick(F.col("target")), F.lit(" (candidates: `"), F.replace("detail", F.lit(", "), F.lit("`, `")), F.lit("`)")))
    )
    blocks = lines(findings, "defect", ["source", "target", "detail"], F.concat(F.lit("- "), text))
    titles = {"broken": "Broken links", "one-way": "One-way links", "orphan": "Orphan notes", "shadowed": "Shadowed links"}
    one = blocks.agg(F.map_from_entries(F.collect_list(F.struct("defect", "n"))).alias("n"), F.map_from_entries(F.collect_list(F.struct("defect", "block"))).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    parts = [F.concat(F.lit(f"## {title} ("), F.coalesce(F.col("n")[c], F.lit(0)).cast("string"), F.lit(")\n"), F.coalesce(F.col("b")[c], F.lit("_none found._")), F.lit("\n")) for c, title in titles.items()]
    head = F.concat(F.lit(f"# Link audit — {name}\n\nScanned "), F.col("nodes").cast("string"), F.lit(" notes. "), F.col("total").cast("string"), F.lit(" findings.\n\n"))
    whole = one.crossJoin(nodes.agg(F.count("*").alias("nodes")))
    return whole.select(F.concat(head, F.array_join(F.array(*parts), "\n")).alias("report"))


def grouped_markdown(rows: DataFrame, title: str, by: str, order: list[str], line: Column) -> DataFrame:
    """[K5-K6, K8-K10] One row: findings under a heading for each group, in the groups' order."""
    blocks = lines(rows, by, order, F.concat(F.lit("- "), line))
    head = F.concat(F.lit("## "), F.col(by).cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.col("block"), F.lit("\n"))
    whole = blocks.agg(F.sort_array(F.collect_list(F.struct(by, head.alias("h")))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return whole.select(F.concat(F.lit(f"# {title}\n\n"), F.col("total").cast("string"), F.lit(" findings.\n\n"), F.array_join(F.transform("all", lambda x: x.h), "\n")).alias("report"))


def as_json(rows: DataFrame, order: list[str], **facts: object) -> DataFrame:
    """[K4-K10] One row: findings as a JSON document with sorted keys and schema_version 1."""
    names = sorted(rows.columns)
    whole = rows.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*names).alias("_f")))).alias("all"))
    fields = {"findings": F.transform("all", lambda x: x["_f"]), "schema_version": F.lit(1)} | {k: F.lit(v) for k, v in facts.items()}
    return whole.select(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}).alias("report"))


def answer_markdown(drafts: DataFrame, order: str, body: str = "body") -> DataFrame:
    """[K7] One row: the stubs in order, with a rule between them."""
    whole = drafts.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("b")))).alias("all"))
    return whole.select(F.array_join(F.transform("all", lambda x: F.regexp_replace(x.b, r"\s+\z", "")), "\n\n---\n\n").alias("report"))


def answer_json(drafts: DataFrame, order: str, **facts: object) -> DataFrame:
    """[K7] as_json() with real numbers to four places."""
    real = [f.name for f in drafts.schema.fields if f.dataType.typeName() in ("double", "float")]
    return as_json(drafts.withColumns({n: F.round(F.col(n), 4) for n in real}), [order], **facts)


def results_text(ranked: DataFrame, items: DataFrame, key: str, source: str, heading: str, text: str) -> DataFrame:
    """[K11] (query_id, report): ranked results with their places and snippets."""
    rows = ranked.join(items.select(key, source, heading, text), key)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(source), F.lit(" — "), F.coalesce(heading, F.lit("")), F.format_string(" (%.4f)\n    ", "score"), t.snippet(F.col(text), 240))
    return lines(rows, "query_id", ["rank"], line).select("query_id", F.col("block").alias("report"))


def borderline(scored: DataFrame, score: str = "score") -> DataFrame:
    """[K15] Matches that a person should look at."""
    return scored.where(F.col(score).isin(3, 4))


def sanitise(items: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """[X2] (key, line, reason, excerpt): lines that match a pattern, in any case. Patterns are columns of the plan, not a table to cross with."""
    rows = items.select(key, F.posexplode(F.split(text, "\n")).alias("i", "content"))
    hits = F.filter(F.array(*(F.when(F.col("content").rlike("(?i)" + p), F.lit(name)) for name, p in patterns.items())), lambda r: r.isNotNull())
    return rows.select(key, (F.col("i") + 1).alias("line"), F.explode(hits).alias("reason"), F.substring("content", 1, 120).alias("excerpt"))
