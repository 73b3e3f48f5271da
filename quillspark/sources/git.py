"""[S5-S8] The history of notes in a git repository as a data source: spark.read.format("git_notes").option("root", ...).load()

One partition for each note, so histories are read in parallel on machines that hold the repository. A revision's text is read under the path that the
note had then, so renames are followed. Only plain git is run, without a shell, with arguments that cannot be options.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "rel_path string, seq int, sha string, ts bigint, content string"
SHA = re.compile(r"[0-9a-fA-F]{4,64}")


class GitError(RuntimeError):
    """git could not do what was asked."""


def run_git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, encoding="utf-8", errors="replace", check=False)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git ended with {done.returncode}")
    return done.stdout


def git_root(path: str) -> str:
    """The top of the repository that holds path."""
    place = Path(path)
    return run_git(str(place if place.is_dir() else place.parent), "rev-parse", "--show-toplevel").strip()


def safe_path(rel: str) -> str:
    if PurePosixPath(rel).is_absolute() or ".." in PurePosixPath(rel).parts:
        raise GitError(f"a path outside of the repository: {rel}")
    return rel


def content_at(root: str, sha: str, rel: str) -> str:
    if not SHA.fullmatch(sha):
        raise GitError(f"not a commit: {sha}")
    return run_git(root, "show", f"{sha}:{safe_path(rel)}")


def revisions(root: str, rel: str, since: int | None = None) -> list[tuple[str, int, str]]:
    """(sha, time, path then) of each commit that touched a note, oldest first; none for an untracked note."""
    log = run_git(root, "log", "--follow", "--first-parent", "-M", "--name-only", "--format=%x01%H%x00%ct", "--", safe_path(rel))
    found = []
    for entry in log.split("\x01")[1:]:
        head, _, names = entry.partition("\n")
        sha, _, at = head.partition("\0")
        path = next((n for n in names.split("\n") if n), rel)
        if since is None or int(at) >= since:
            found.append((sha, int(at), path))
    return found[::-1]


class NotePartition(InputPartition):
    def __init__(self, rel: str):
        self.rel = rel


class NoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.only, self.since = git_root(options["root"]), options.get("only"), options.get("since")

    def partitions(self) -> list[NotePartition]:
        files = run_git(self.root, "ls-files", "-z", "--", "*.md").split("\0")
        return [NotePartition(f) for f in sorted(files) if f and (not self.only or self.only in (f, PurePosixPath(f).name))]

    def read(self, partition: NotePartition) -> Iterator[tuple]:
        for seq, (sha, at, path) in enumerate(revisions(self.root, partition.rel, int(self.since) if self.since else None)):
            try:
                yield partition.rel, seq, sha, at, content_at(self.root, sha, path)
            except GitError:  # the commit that took the note away has no text
                continue


class GitNotes(DataSource):
    """Options: root, only (a file's name or path), since (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "git_notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> NoteReader:
        return NoteReader(dict(self.options))


def read_history(spark: SparkSession, root: str, only: str | None = None, since: int | None = None):
    """The revisions of all notes of a repository: rel_path, seq, sha, ts, content."""
    spark.dataSource.register(GitNotes)
    reader = spark.read.format("git_notes").option("root", root)
    for name, value in (("only", only), ("since", since)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()
