"""Versions of a graph: commits, branches, merges and time travel.

Each commit is a folder with the whole snapshot and a row in the log; its id is
the hash of parents, message and content, so equal content under equal parents
is one commit.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.model import SCHEMAS, Ontology
from graphloom.operators.store import merge
from graphloom.session import scratch
from graphloom.sources.manifest import ManifestLog


class VersionError(RuntimeError):
    """A branch or commit that does not exist, exists already, or cannot be merged."""


class _Moved(Exception):
    """A head is no longer where it was."""


@dataclass(frozen=True)
class Commit:
    """One version: its parents, who made it and why, and where its snapshot is."""

    id: str
    parents: tuple[str, ...]
    message: str
    author: str
    at: str
    part: str
    vocabulary: tuple[tuple[str, str], ...]
    iri: str | None


def content_hash(graph: Ontology) -> str:
    """A digest of all rows, whatever their order: hashed row by row and summed per part."""
    parts = []
    for name in Ontology.PARTS:
        df = getattr(graph, name)
        sums = df.select(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("*")).first()
        parts.append([name, str(sums[0]), sums[1]])
    return hashlib.sha256(json.dumps([parts, sorted(graph.vocabulary.items()), graph.iri]).encode()).hexdigest()


class VersionedStore:
    """Commits and branches under ``root``; every change publishes a new manifest.

    Each change is made to the newest manifest, and made anew if another writer
    was faster, so no commit and no branch is lost.  The current branch belongs
    to this object, not to the folder.
    """

    def __init__(self, spark: SparkSession, root: str, main: str = "main"):
        self.spark, self.log, self.current = spark, ManifestLog(spark, root), main
        self._load(self.log.latest()[1])

    def _load(self, manifest: dict) -> None:
        self.commits = {c["id"]: Commit(**c | {"parents": tuple(c["parents"]), "vocabulary": tuple(map(tuple, c["vocabulary"]))}) for c in manifest.get("commits", [])}
        self.heads: dict[str, str | None] = {self.current: None} | manifest.get("heads", {})

    def _update(self, change: Callable[[], None]) -> None:
        """Publish what ``change`` does to the newest commits and heads."""

        def made(version: int, manifest: dict) -> dict:
            self._load(manifest)
            change()
            return {"commits": [asdict(c) for c in self.commits.values()], "heads": self.heads}

        self.log.update(made)

    def _commit(self, graph: Ontology, parents: Callable[[], tuple[str, ...]], message: str, author: str) -> str:
        content, written, made = content_hash(graph), "", ""

        def change() -> None:
            nonlocal written, made
            above = parents()
            made = hashlib.sha256(json.dumps([above, message, content]).encode()).hexdigest()
            if made not in self.commits:
                if not written:
                    written = scratch(self.spark, "commit").rpartition("/")[2]
                    for name in Ontology.PARTS:
                        getattr(graph, name).write.parquet(f"{self.log.root}/{written}/{name}")
                now = datetime.datetime.now(datetime.UTC).isoformat()
                self.commits[made] = Commit(made, above, message, author, now, written, tuple(sorted(graph.vocabulary.items())), graph.iri)
            self.heads[self.current] = made

        self._update(change)
        return made

    def commit(self, message: str, author: str, graph: Ontology) -> str:
        """A new head of the current branch, above whatever is its head when it is published."""
        return self._commit(graph, lambda: (h,) if (h := self.heads[self.current]) else (), message, author)

    def branch(self, name: str) -> None:
        """A new branch at the current head."""

        def change() -> None:
            if name in self.heads:
                raise VersionError(f"branch {name} exists")
            if self.heads[self.current] is None:
                raise VersionError("the current branch has no commit")
            self.heads[name] = self.heads[self.current]

        self._update(change)

    def checkout(self, name: str) -> None:
        """Make a branch the current one of this object."""
        self._load(self.log.latest()[1])
        if name not in self.heads:
            raise VersionError(f"no branch {name}")
        self.current = name

    def move(self, name: str, commit: str) -> None:
        """Point a branch at a commit."""

        def change() -> None:
            if commit not in self.commits:
                raise VersionError(f"no commit {commit}")
            self.heads[name] = commit

        self._update(change)

    def merge(self, other: str, strategy: str = "union", author: str = "") -> str:
        """Merge a branch into the current one; the commit has both heads as parents.

        If either head has moved before the merge is published, the new heads
        are merged.
        """
        while True:
            self._load(self.log.latest()[1])
            if other == self.current:
                raise VersionError("a branch cannot be merged with itself")
            if other not in self.heads:
                raise VersionError(f"no branch {other}")
            ours, theirs = self.heads[self.current], self.heads[other]
            if ours is None or theirs is None:
                raise VersionError("a branch without a commit cannot be merged")
            if ours == theirs:
                raise VersionError("both branches have the same head")

            def heads(ours: str = ours, theirs: str = theirs) -> tuple[str, ...]:
                if (self.heads[self.current], self.heads[other]) != (ours, theirs):
                    raise _Moved
                return ours, theirs

            try:
                return self._commit(merge(self.as_of(ours), self.as_of(theirs), strategy), heads, f"merge {other} into {self.current}", author)
            except _Moved:
                continue

    def as_of(self, commit: str) -> Ontology:
        """The snapshot of a commit."""
        if commit not in self.commits:
            raise VersionError(f"no commit {commit}")
        c = self.commits[commit]
        parts = {n: self.spark.read.schema(s).parquet(f"{self.log.root}/{c.part}/{n}") for n, s in SCHEMAS.items()}
        return Ontology(**parts, vocabulary=dict(c.vocabulary), iri=c.iri)

    def head(self) -> Commit | None:
        """The newest commit of the current branch."""
        id = self.heads[self.current]
        return self.commits[id] if id else None

    def history(self) -> list[Commit]:
        """Commits behind the head, breadth first over all parents."""
        out, queue = [], [self.heads[self.current]] if self.heads[self.current] else []
        for id in queue:
            out.append(self.commits[id])
            queue += [p for p in self.commits[id].parents if p in self.commits and p not in queue]
        return out
