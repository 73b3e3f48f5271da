"""The link graph of notes [J1-J6, A2-A4] as three tables: nodes, resolved links, edges. All joins are on one key; Spark picks how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def nodes(notes: DataFrame) -> DataFrame:
    return notes.select(t.node_name(F.col("source_rel")).alias("node")).distinct()


def keys(nodes_: DataFrame) -> DataFrame:
    """What a node can be called: its path and its last part."""
    path = F.lower("node")
    return nodes_.select("node", F.explode(F.array_distinct(F.array(path, F.substring_index(path, "/", -1)))).alias("key"))


def links(notes: DataFrame) -> DataFrame:
    """[J1, J2] (source, target_raw, is_embed, resolved): each distinct link with the sorted nodes that it may mean, less its own note.
    A link to its own note alone is left out. `resolved` is empty for a broken link."""
    found = notes.select(t.node_name(F.col("source_rel")).alias("source"), F.explode(t.wikilinks(F.col("body"))).alias("l"))
    found = found.select("source", F.col("l.target").alias("target_raw"), F.col("l.is_embed").alias("is_embed")).distinct()
    found = found.withColumn("key", t.link_key(F.col("target_raw")))
    meant = found.join(keys(nodes(notes)), "key", "left").groupBy("source", "target_raw", "is_embed").agg(F.sort_array(F.collect_set("node")).alias("all"))
    meant = meant.withColumn("resolved", F.array_remove("all", F.col("source")))
    return meant.where((F.size("resolved") > 0) | (F.size("all") == 0)).drop("all")


def edges(links_: DataFrame) -> DataFrame:
    return links_.select("source", F.explode("resolved").alias("target"))


def broken(links_: DataFrame) -> DataFrame:
    """[J3]"""
    return links_.where(F.size("resolved") == 0).select("source", "target_raw", "is_embed")


def one_way(links_: DataFrame) -> DataFrame:
    """[J4] Edges that no edge answers; a link and an embed of one note give a row each."""
    out = edges(links_)
    back = out.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return out.join(back, ["source", "target"], "left_anti")


def orphans(links_: DataFrame) -> DataFrame:
    """[J5] Notes that link to others while none links to them."""
    outbound = links_.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outbound_count"))
    return outbound.join(edges(links_).select(F.col("target").alias("node")).distinct(), "node", "left_anti")


def shadowed(links_: DataFrame) -> DataFrame:
    """[J6] Links that may mean several notes."""
    return links_.where(F.size("resolved") >= 2).select("source", "target_raw", F.col("resolved").alias("candidates"))


def degrees(notes: DataFrame, links_: DataFrame) -> DataFrame:
    """[A2, A3] Every node with its numbers of links out and of distinct notes that link in, and these."""
    out = links_.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outbound"))
    into = edges(links_).groupBy(F.col("target").alias("node")).agg(F.sort_array(F.collect_set("source")).alias("inbound_from"))
    rows = nodes(notes).join(out, "node", "left").join(into, "node", "left")
    return rows.select("node", F.coalesce("outbound", F.lit(0)).alias("outbound"), F.coalesce(F.size("inbound_from"), F.lit(0)).cast("long").alias("inbound"), F.coalesce("inbound_from", F.array().cast("array<string>")).alias("inbound_from"))


def audit(notes: DataFrame, only: tuple[str, ...] = ("broken", "one-way", "orphan", "shadowed")) -> DataFrame:
    """[C3, P1, T2] All findings as (defect, source, target, detail); orphans have no target. The classes share one plan of links, whose shuffles are reused."""
    unknown = set(only) - {"broken", "one-way", "orphan", "shadowed"}
    if unknown:
        raise ValueError(f"unknown class {sorted(unknown)[0]}")
    found = links(notes)
    none = F.lit(None).cast("string")
    parts = {
        "broken": broken(found).select("source", F.col("target_raw").alias("target"), F.when(F.col("is_embed"), "embed").otherwise("link").alias("detail")),
        "one-way": one_way(found).select("source", "target", none.alias("detail")),
        "orphan": orphans(found).select(F.col("node").alias("source"), none.alias("target"), F.col("outbound_count").cast("string").alias("detail")),
        "shadowed": shadowed(found).select("source", F.col("target_raw").alias("target"), F.array_join("candidates", ", ").alias("detail")),
    }
    out = None
    for name in parts:
        if name in only:
            part = parts[name].select(F.lit(name).alias("defect"), "source", "target", "detail")
            out = part if out is None else out.unionAll(part)
    return out


def audit_totals(findings: DataFrame) -> DataFrame:
    """[A4]"""
    return findings.groupBy("defect").agg(F.count("*").alias("findings"))
