"""How records get from a source to a projector: once, again and again, on a save, event by event, or in a way of one's own."""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Ontology
from graphloom.session import cut
from graphloom.streaming.projection import Records
from graphloom.streaming.sources import BEGINNING, ActorSource


@dataclass(frozen=True)
class Batch:
    """Records that are committed together.  ``name`` tells the batch from all others of its source: under one name it is committed once."""

    records: Records
    cursor: int
    origin: str
    name: str


class Ingest(Protocol):
    """A way of ingesting; write one's own by giving ``label`` and ``batches``."""

    label: str

    def batches(self, source: ActorSource) -> Iterator[Batch]: ...


def gathered(source: ActorSource, since: int, origin: str, with_paths: bool = True, actors_of_paths: bool = False) -> Batch | None:
    """What a source has after ``since``, with the states of the actors concerned; None if there is nothing.

    The cursor is read first and bounds the events, so an event that arrives
    meanwhile belongs to the next batch and not to both or none.
    """
    cursor = source.cursor()
    events = source.journal(since)
    if not getattr(source, "counts_snapshots", False):
        events = events.where(F.col("version") <= cursor)
    events = cut(events.withColumn("batch", F.lit(f"{since}-{cursor}")))
    paths = source.paths()
    paths = paths if with_paths else paths.where("false")
    if events.isEmpty() and (not with_paths or paths.isEmpty()):
        return None
    actors = events.select("actor")
    if actors_of_paths and "actor" in paths.columns:
        actors = actors.unionByName(paths.select("actor"))
    return Batch(Records(paths, events, source.states(actors.where("actor is not null"))), cursor, origin, f"{origin}:{since}:{cursor}")


@dataclass
class Replay:
    """Once, all that comes after ``since``."""

    since: int = BEGINNING
    label: str = "replay"

    def batches(self, source: ActorSource) -> Iterator[Batch]:
        batch = gathered(source, self.since, self.label, actors_of_paths=True)
        if batch is not None:
            yield batch


@dataclass
class Polling:
    """Every ``every`` seconds what has come since the last time; a tick that finds nothing gives no batch.

    It goes on until ``stop`` is called, or for so many ``ticks``.  The cursor
    moves on only when the batch has been taken, that is, committed.
    """

    every: float = 1.0
    ticks: int | None = None
    with_paths: bool = True
    since: int = BEGINNING
    label: str = "polling"

    def __post_init__(self) -> None:
        self._stopped = threading.Event()

    def stop(self) -> None:
        self._stopped.set()

    def batches(self, source: ActorSource) -> Iterator[Batch]:
        tick = 0
        while not self._stopped.is_set() and (self.ticks is None or tick < self.ticks):
            tick += 1
            batch = gathered(source, self.since, self.label, self.with_paths)
            if batch is not None:
                yield batch
                self.since = batch.cursor
            if self.ticks is None or tick < self.ticks:
                self._stopped.wait(self.every)


class PushHook:
    """A batch on every save: ``wrap`` a checkpointer, and each of its saves wakes the ingest."""

    def __init__(self, label: str = "push-hook"):
        self.label, self.since = label, BEGINNING
        self._saves: queue.Queue[int | None] = queue.Queue()

    def wrap(self, checkpointer: Any) -> HookedCheckpointer:
        return HookedCheckpointer(checkpointer, self._saves.put)

    def close(self) -> None:
        """End the ingest after the saves so far."""
        self._saves.put(None)

    def batches(self, source: ActorSource) -> Iterator[Batch]:
        while self._saves.get() is not None:
            batch = gathered(source, self.since, self.label)
            if batch is not None:
                yield batch
                self.since = batch.cursor


class HookedCheckpointer:
    """A checkpointer that tells a listener the version of each save."""

    def __init__(self, inner: Any, listener: Any):
        self.inner, self.listener = inner, listener

    @property
    def version(self) -> int:
        return self.inner.version

    def save(self, graph: Ontology, activities: DataFrame | None = None) -> int:
        version = self.inner.save(graph, activities)
        self.listener(version)
        return version

    def load(self) -> Ontology | None:
        return self.inner.load()

    def activities(self) -> DataFrame | None:
        return self.inner.activities()


class EventStream:
    """A batch per event, in the order they are pushed: the finest and dearest way, for events that come now and then.

    For streams of many events use ``Projector.stream``, which commits
    micro-batches.
    """

    def __init__(self, label: str = "event-stream"):
        self.label = label
        self._events: queue.Queue[tuple | None] = queue.Queue()

    def push(self, event: tuple) -> None:
        """An event as a row of projector.EVENTS."""
        self._events.put(event)

    def close(self) -> None:
        self._events.put(None)

    def batches(self, source: ActorSource) -> Iterator[Batch]:
        from graphloom.streaming.projector import EVENTS, PATHS

        while (event := self._events.get()) is not None:
            spark = source.paths().sparkSession
            events = spark.createDataFrame([event], EVENTS)
            version, actor, path = event[0], event[2], event[3]
            paths = spark.createDataFrame([] if path is None else [(path, {})], PATHS)
            yield Batch(Records(paths, events, source.states(events.select("actor"))), version, self.label, f"{self.label}:{actor}:{version}")
