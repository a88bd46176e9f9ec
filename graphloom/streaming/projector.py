"""From a stream of actor records to a committed graph.

A micro-batch is projected, checked against the schema, reconciled with what is
stored, and committed under an activity whose id comes from the query and the
batch, so that a batch delivered again after a failure is committed once.  The
stream's checkpoint is the cursor.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.model import Ontology
from graphloom.operators.once import OnceIndex, identifier
from graphloom.operators.provenance import Activity, ProvenanceLog
from graphloom.operators.store import Delta, checked_against_schema, reconcile_nodes
from graphloom.session import cut
from graphloom.sources.delta_store import DeltaStore
from graphloom.sources.manifest import CommitConflict
from graphloom.streaming.ingest import Ingest
from graphloom.streaming.projection import PROJECTIONS, Minting, Records
from graphloom.streaming.sources import ActorSource

EVENTS = "version bigint, token string, actor string, path string, kind string, at timestamp, payload string, batch string, pos bigint"
PATHS = "path string, attributes map<string,string>"
STATES = "actor string, payload string, digest string"


class ProjectorError(RuntimeError):
    """A projector that is not fully configured."""


@dataclass
class Report:
    """Batches, nodes, edges and activities a run has committed."""

    batches: int = 0
    nodes: int = 0
    edges: int = 0
    activities: int = 0


@dataclass
class Projector:
    """Projects records into ``store``.

    ``projection`` is a name of PROJECTIONS or a function like them.  ``policy``
    says what happens to nodes that exist; edges are always replaced.  With
    ``fixed_schema`` types and labels that it does not declare are refused.
    ``seen`` is where the snapshot-diff shape keeps what it has emitted.
    """

    store: DeltaStore
    projection: str | Callable[..., Delta]
    ledger: ProvenanceLog | None = None
    source: str = ""
    minting: Minting = field(default_factory=Minting)
    policy: str = "last_write_wins"
    fixed_schema: Ontology | None = None
    seen: str | None = None
    report: Report = field(default_factory=Report)

    def __post_init__(self) -> None:
        if isinstance(self.projection, str) and self.projection not in PROJECTIONS:
            raise ProjectorError(f"no projection {self.projection}")
        if self.projection == "snapshot_diff" and not self.seen:
            raise ProjectorError("snapshot_diff needs a folder for what it has seen")

    def _unseen(self, records: Records, seen: dict) -> tuple[Records, dict]:
        """Records that no committed batch has emitted, and the identifiers seen once these are committed too."""
        spark = records.events.sparkSession
        out, now = [], {}
        for name, rows, key in (("paths", records.paths, ("path",)), ("events", records.events, ("actor", "version")), ("states", records.states.withColumn("digest", F.coalesce("digest", F.lit("<none>"))), ("actor", "digest"))):
            index = OnceIndex(spark, f"{self.seen}/{name}")
            rows = cut(rows.withColumn("id", identifier(*key)))
            new = cut(index.looked_up(seen.get(name, []), rows.select("id"), [], rows.count()).where("not known").select("id"))
            n = new.count()
            now[name] = index.extended(seen.get(name, []), new, n) if n else seen.get(name, [])
            out.append(rows.join(new, "id", "left_semi").drop("id"))
        return Records(*out), now

    def commit(self, records: Records, name: str, cursor: int | None = None) -> bool:
        """Project and commit one batch; False if there is nothing in it or it has been committed before.

        Graph, activity and, for the snapshot-diff shape, the identifiers seen
        are published with one manifest, computed on the version before it; if
        another writer publishes meanwhile the batch is projected anew.  So a
        batch that failed can be repeated, and no update of a node is lost.
        """
        label = self.projection if isinstance(self.projection, str) else self.projection.__name__
        activity = Activity(f"project:{label}", id=hashlib.sha256(f"{self.source}|{label}|{name}".encode()).hexdigest()).with_attribute("projection", label).with_attribute("source", self.source)
        if cursor is not None:
            activity = activity.with_attribute("cursor_version", cursor)
        project = PROJECTIONS[self.projection] if isinstance(self.projection, str) else self.projection
        minted: Delta | None = None
        while True:
            version, manifest = self.store.state()
            if self.store.is_done(manifest, activity.id):
                if self.ledger is not None:  # the failure may have come before this; of one id the ledger counts one
                    self.ledger.record(activity.finish())
                return False
            seen: dict = {}
            if self.projection == "snapshot_diff":
                fresh, seen = self._unseen(records, manifest.get("seen", {}))
                minted = None
            else:
                fresh = records
            if minted is None:
                delta = project(fresh, self.source, self.minting)
                minted = Delta(cut(delta.nodes) if delta.nodes is not None else None, cut(delta.edges) if delta.edges is not None else None, delta.axioms)
                if self.fixed_schema is not None:
                    checked_against_schema(self.fixed_schema, minted)
            nodes = minted.nodes
            if nodes is not None and self.policy != "last_write_wins":
                nodes = cut(reconcile_nodes(self.store.graph(version).nodes, nodes, self.policy))
            n_nodes = nodes.count() if nodes is not None else 0
            n_edges = minted.edges.count() if minted.edges is not None else 0
            if not n_nodes and not n_edges:
                return False
            try:
                self.store.commit(Delta(nodes, minted.edges, minted.axioms), activity.finish(), version, (lambda _: {"seen": seen}) if seen else None)
            except CommitConflict:
                continue
            break
        if self.ledger is not None:
            self.ledger.record(activity.finish())
        self.report.batches += 1
        self.report.nodes += n_nodes
        self.report.edges += n_edges
        self.report.activities += 1
        return True

    # ingest modes

    def run(self, source: ActorSource | None, *ingests: Ingest) -> Report:
        """Commit the batches of all ingests, one ingest after the other; returns the report.

        Several ingests may see the same records: a batch counts once under its
        name, and nodes and edges by their ids.
        """
        if source is None:
            raise ProjectorError("no source")
        if not ingests:
            raise ProjectorError("no ingest")
        for ingest in ingests:
            for batch in ingest.batches(source):
                self.commit(batch.records, f"{source.label}:{batch.name}", batch.cursor)
        return self.report

    def replay(self, records: Records, since: int = -1, name: str = "replay") -> bool:
        """One batch: all paths, events after ``since``, states of the actors among them."""
        events = records.events.where(F.col("version") > since)
        actors = events.select("actor")
        if "actor" in records.paths.columns:
            actors = actors.unionByName(records.paths.select("actor"))
        states = records.states.join(actors.distinct(), "actor", "left_semi") if "actor" in records.paths.columns else records.states
        cursor = events.agg(F.max("version")).first()[0]
        return self.commit(Records(records.paths, events, states), f"{name}:{since}:{cursor}", cursor)

    def stream(self, events: DataFrame, checkpoint: str, paths: DataFrame | None = None, states: DataFrame | None = None, every: str | None = None, events_only: bool = True) -> StreamingQuery:
        """Start a query over a streaming frame of events: to the end of what is there, or, with ``every``, on and on.

        With ``events_only`` false the paths and states come with each batch, as
        polling does.
        """
        spark = events.sparkSession

        def take(batch: DataFrame, number: int) -> None:
            held = batch.sparkSession
            none = lambda schema: held.createDataFrame([], schema)
            with_rest = not events_only
            rows = cut(batch.withColumn("batch", F.lit(str(number))))
            records = Records(paths if paths is not None and with_rest else none(PATHS), rows, states if states is not None and with_rest else none(STATES))
            self.commit(records, f"{checkpoint}:{number}", rows.agg(F.max("version")).first()[0])

        writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        spark.sparkContext.setLocalProperty("spark.job.description", f"project {self.source}")
        return writer.start()


def event_files(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the event files that arrive in a folder; ``per_batch`` files make a batch, 1 for the finest."""
    reader = spark.readStream.schema(EVENTS)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def cursor_of(activity_attributes: dict[str, str]) -> int | None:
    """The cursor that an activity recorded."""
    said = activity_attributes.get("cursor_version")
    return None if said is None else json.loads(said)
