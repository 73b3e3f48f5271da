"""Stubs as files, and dated sections of a report: what the driver writes, a file for each gap."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def target(out_dir: str | Path, name: str | None, title: str) -> Path:
    """Where a stub goes; ValueError for a title that has no safe name or leads out of the folder (by a link, say)."""
    root = Path(out_dir).resolve()
    place = (root / f"{name}.md").resolve() if name else root
    if not name or not place.is_relative_to(root):
        raise ValueError(f"unsafe stub title: {title!r}")
    return place


def write_stubs(drafts: DataFrame, out_dir: str | Path, title: str = "suggested_note_title", body: str = "body") -> list[Path]:
    """[K12] A file for each draft, sorted by title; the files written. ValueError for an unsafe title or two of one name, FileExistsError if any of them is there: then none is written.

    Names are collected, a row for each gap; texts come to the driver one partition at a time.
    """
    rows = drafts.select(F.col(title).alias("title"), t.safe_name(F.col(title)).alias("name"), F.col(body).alias("body"))
    names = {r.title: target(out_dir, r.name, r.title) for r in rows.select("title", "name").orderBy("title").collect()}
    if len(set(names.values())) < rows.count():
        raise ValueError("two stubs have one name")
    there = [str(p) for p in names.values() if p.exists()]
    if there:
        raise FileExistsError(", ".join(there))
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    for r in rows.toLocalIterator():
        names[r.title].write_text(r.body or "", encoding="utf-8")
    return list(names.values())


def append_section(path: str | Path, title: str, lines: Iterable[str], at: datetime | None = None) -> str:
    """[K14] A dated section at the end of a Markdown file (made if it is not there); the section."""
    section = f"\n## {(at or datetime.now(tz=UTC)).strftime('%Y-%m-%d %H:%M:%S')} — {title}\n\n" + "\n".join(lines) + "\n"
    with open(path, "a", encoding="utf-8") as f:
        f.write(section)
    return section
