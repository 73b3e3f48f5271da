"""python -m quillspark.cli COMMAND: 0 nothing found, 1 findings, 2 a mistake in what was asked [P16, C10-C12]."""

from __future__ import annotations

import argparse
import sys

from .operators import links, notes, reports
from .operators.store import ChunkTable
from .plans import commands
from .session import session
from .sources.git import GitError, git_root, read_history
from .sources.vault import read_vault


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = top.add_subparsers(dest="command")

    def add(name: str, *args: str, **flags: object) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        for flag, default in flags.items():
            if default is bool:
                p.add_argument("--" + flag.replace("_", "-"), action="store_true")
            else:
                p.add_argument("--" + flag.replace("_", "-"), default=default, type=type(default) if default is not None else str)
        return p

    add("ingest", "root", db=".quillspark/db")
    add("query", "text", db=".quillspark/db", mode="rerank", k=5)
    add("audit", "root", only=None, json=bool)
    add("contradict", db=".quillspark/db", k=10, min_score=0.5, only=None)
    add("gap", db=".quillspark/db", min_size=3, limit=30)
    add("answer", "gaps", db=".quillspark/db", k=8, min_supporting=2)
    add("drift", "root", only=None, min_score=4)
    add("concepts", db=".quillspark/db", min_size=3, absence=0.2)
    add("confidence", "root", only=None, threshold=2, min_confidence=0.0)
    return top


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command is None:
        p.print_help()
        return 0
    spark = session()
    try:
        if a.command in ("query", "contradict", "gap", "answer", "concepts") and not ChunkTable(spark, a.db).count():
            raise ValueError(f"no index in {a.db}; run ingest first")
        if a.command == "ingest":
            commands.ingest(spark, a.root, ChunkTable(spark, a.db)).show()
            return 0
        if a.command == "query":
            found = commands.query(spark, ChunkTable(spark, a.db), a.text, a.mode, a.k).collect()
            print("\n".join(f"[{r['rank']}] {r['source_rel']} — {r['heading_path']} ({r['score']:.4f})\n    {r['text'].strip().replace(chr(10), ' ')[:240]}" for r in found))
            return 0
        if a.command == "audit":
            parsed = notes.parse_notes(read_vault(spark, a.root))
            found = links.audit(parsed, tuple(a.only.split(",")) if a.only else ("broken", "one-way", "orphan", "shadowed"))
            report = reports.as_json(found, ["defect", "source", "target"]) if a.json else reports.audit_markdown(found, links.nodes(parsed), a.root)
            print(report.first()["report"])
            return int(not links.audit(parsed).isEmpty())  # of all classes, whatever was shown
        if a.command == "drift":
            found = commands.drift(read_history(spark, git_root(a.root), a.only), min_score=a.min_score)
        elif a.command == "confidence":
            found = commands.confidence(spark, a.root, only=a.only, threshold=a.threshold, min_confidence=a.min_confidence)
        elif a.command == "contradict":
            found = commands.contradict(ChunkTable(spark, a.db), k=a.k, min_score=a.min_score, scope=a.only)
        elif a.command == "gap":
            found = commands.gap(ChunkTable(spark, a.db), min_size=a.min_size, limit=a.limit)
        elif a.command == "answer":
            found = commands.answer(spark, ChunkTable(spark, a.db), a.gaps, a.k, a.min_supporting)
        else:
            found = commands.concepts(ChunkTable(spark, a.db), min_size=a.min_size, absence=a.absence)
        found = found.persist()
        for row in found.toLocalIterator():
            print(row.asDict())
        return int(not found.isEmpty())
    except (ValueError, FileNotFoundError, NotADirectoryError, GitError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
