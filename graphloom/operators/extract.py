"""Terms, entities, relations, records, concepts and axioms from texts, by a language model one supplies.

The model is asked once per distinct prompt, in batches on the executors; its
answers are JSON and are read by Spark.  No model comes with this package.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Ontology, axiom_id, edge_id, node_id, properties_of, pv_of, random_id, record_id
from graphloom.operators import store
from graphloom.operators.provenance import Activity
from graphloom.operators.store import Delta
from graphloom.session import written

# fixed values: what each stage asks for, and the form of an answer's rows
STAGES = {
    "terms": ("List the domain terms of this text as a JSON array of {surface, score, category, context}:\n", "surface string, score float, category string, context string"),
    "entities": ("Resolve these terms to entities as a JSON array of {surface, iri, type_name, score, is_new}:\n", "surface string, iri string, type_name string, score float, is_new boolean"),
    "relations": ("List the relations in this text as a JSON array of {source, label, target, score}:\n", "source string, label string, target string, score float"),
    "records": ("Turn this row into a JSON object {iri, type_name, properties, outbound, source}:\n", "iri string, type_name string, properties map<string,string>, outbound array<array<string>>, source string"),
    "clusters": ("Group these terms into concepts as a JSON array of {name, members, description, score}:\n", "name string, members array<string>, description string, score float"),
    "subclasses": ("Propose subclass relations as a JSON array of {sub, sup, score}:\n", "sub string, sup string, score float"),
    "axioms": ("Propose axioms as a JSON array of {kind, a, b, score}:\n", "kind string, a string, b string, score float"),
}


class BackendError(RuntimeError):
    """A model that did not answer."""


class Backend(Protocol):
    """A language model.  One that answers many prompts at once may also have ``complete_batch``, a list of answers to a list of prompts."""

    label: str

    def complete(self, prompt: str) -> str: ...


def complete_batch(backend: Backend, prompts: list[str]) -> list[str]:
    """Answers to prompts, at once where the backend can."""
    many = getattr(backend, "complete_batch", None)
    answers = many(prompts) if many else [backend.complete(p) for p in prompts]
    if len(answers) != len(prompts):
        raise BackendError(f"{len(answers)} answers to {len(prompts)} prompts")
    return answers


def stream_complete(backend: Backend, prompt: str) -> Iterator[tuple[str, bool]]:
    """Pieces of an answer with whether they are the last: those of the backend's ``stream_complete``, else the whole answer as one."""
    pieces = getattr(backend, "stream_complete", None)
    yield from pieces(prompt) if pieces else [(backend.complete(prompt), True)]


class MockBackend:
    """Scripted answers in turn, or by what the prompt contains; remembers the prompts."""

    label = "mock"

    def __init__(self, answers: list[str] | dict[str, str]):
        self.answers = deque(answers) if isinstance(answers, list) else answers
        self.prompts: list[str] = []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        if isinstance(self.answers, dict):
            return next((a for k, a in self.answers.items() if k in prompt), "[]")
        if not self.answers:
            raise BackendError("no answer left")
        return self.answers.popleft()


class CachedBackend:
    """A backend that is asked once per prompt, as its policy says.

    ``none`` asks every time, ``content`` keeps every answer by the hash of its
    prompt, ``lru`` keeps ``most``, the one unused for longest going first.
    With ``folder``, one that all executors share, answers are also kept as
    files there, so they hold for all workers and later runs.
    """

    def __init__(self, inner: Backend, policy: str = "content", most: int = 0, folder: str | None = None):
        if policy not in ("none", "content", "lru"):
            raise ValueError(f"no such policy: {policy}")
        self.inner, self.policy, self.most, self.folder, self.label = inner, policy, most, folder, f"cached:{inner.label}"
        self._held: OrderedDict[str, str] = OrderedDict()

    def _file(self, key: str) -> Path | None:
        return Path(self.folder.removeprefix("file://")) / key[:2] / key if self.folder else None

    def complete(self, prompt: str) -> str:
        return self.complete_batch([prompt])[0]

    def complete_batch(self, prompts: list[str]) -> list[str]:
        if self.policy == "none":
            return complete_batch(self.inner, prompts)
        keys = [hashlib.sha256(p.encode("utf-8", "surrogatepass")).hexdigest() for p in prompts]
        found: dict[str, str] = {}
        missing: dict[str, str] = {}
        for key, prompt in zip(keys, prompts, strict=True):
            file = self._file(key)
            if key in self._held:
                self._held.move_to_end(key)
                found[key] = self._held[key]
            elif file is not None and file.exists():
                found[key] = file.read_text("utf-8")
            else:
                missing[key] = prompt
        for key, answer in zip(missing, complete_batch(self.inner, list(missing.values())) if missing else (), strict=True):
            found[key] = answer
            if (file := self._file(key)) is not None:
                file.parent.mkdir(parents=True, exist_ok=True)
                part = file.with_name(f".{key}.{uuid.uuid4().hex}")
                part.write_text(answer, "utf-8")
                part.replace(file)
        for key in keys:
            self._held[key] = found[key]
            self._held.move_to_end(key)
            if self.policy == "lru" and self.most and len(self._held) > self.most:
                self._held.popitem(last=False)
        return [found[key] for key in keys]


def strip_fence(text: Column) -> Column:
    """An answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def ask(df: DataFrame, prompt: Column, backend: Backend, answer: str = "answer") -> DataFrame:
    """``df`` with the model's answers; each distinct prompt is asked once, a null one not at all."""
    prompted = df.withColumn("_prompt", prompt)
    distinct = prompted.select("_prompt").where("_prompt is not null").distinct()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_prompt": b["_prompt"], "_answer": complete_batch(backend, b["_prompt"].tolist())})

    answers = distinct.mapInPandas(rows, "_prompt string, _answer string").withColumnRenamed("_answer", answer)
    return prompted.join(answers, "_prompt", "left").drop("_prompt")


def extract(df: DataFrame, text: str, stage: str, backend: Backend, keys: list[str], known: str | None = None) -> DataFrame:
    """(keys, the columns of the stage): the rows of the model's answers to each text; an answer that cannot be read gives none.

    ``known`` names a column of what is known already (the entities of a text,
    say), which is shown to the model as JSON after the text.
    """
    lead, form = STAGES[stage]
    shown = F.concat(F.lit("\nKnown: "), F.coalesce(F.to_json(F.col(known)), F.lit("[]"))) if known else F.lit("")
    answered = ask(df.select(*keys, text, *([known] if known else [])), F.concat(F.lit(lead), F.col(text), shown), backend)
    single = stage == "records"
    answer = strip_fence(F.col("answer"))
    parsed = F.when(answer.startswith("{"), F.from_json(answer, f"struct<{form}>")) if single else F.from_json(answer, f"array<struct<{form}>>")
    rows = answered.select(*keys, (F.array(parsed) if single else parsed).alias("rows"))
    return rows.select(*keys, F.explode("rows").alias("r")).where("r is not null").select(*keys, "r.*")


def extracted(df: DataFrame, text: str, stage: str, backend: Backend, keys: list[str], known: str | None = None, agent: str | None = None) -> tuple[DataFrame, Activity]:
    """The rows of ``extract``, asked for once and written, and the finished activity that tells by which model and how many."""
    activity = Activity(f"{stage}-extraction", agent=agent).with_attribute("backend", backend.label)
    rows = written(extract(df, text, stage, backend, keys, known), "extracted")
    return rows, activity.with_attribute("rows", rows.count()).finish()


def entity_nodes(entities: DataFrame, iri_required: bool = False) -> DataFrame:
    """Nodes of entities (surface, iri, type_name), one per iri or, without one, per surface and type; with ``iri_required`` those without are left out."""
    rows = entities.where("iri is not null" if iri_required else "surface is not null").groupBy("iri", "type_name", F.when(F.col("iri").isNull(), F.col("surface")).alias("key")).agg(F.min("surface").alias("surface"))
    id_ = F.when(F.col("iri").isNotNull(), node_id(F.col("iri"))).otherwise(node_id(F.concat_ws("|", F.lit("surface"), "key", "type_name")))
    return rows.select(id_.alias("id"), "iri", F.array_compact(F.array("type_name")).alias("types"), properties_of(name=pv_of(F.col("surface"), "string")).alias("properties"), "surface")


def relation_edges(relations: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Edges of relations (source, label, target) whose ends both stand in ``surfaces`` (surface, id); others are dropped."""
    s = surfaces.groupBy("surface").agg(F.min("id").alias("id"))
    rows = relations.join(s.select(F.col("surface").alias("source"), F.col("id").alias("sid")), "source").join(s.select(F.col("surface").alias("target"), F.col("id").alias("tid")), "target")
    none = F.lit(None).cast("map<string,struct<t:string,s:string,i:bigint,f:double,b:boolean,ts:timestamp,bin:binary>>")
    return rows.select(edge_id(F.col("sid"), F.col("label"), F.col("tid")).alias("id"), "label", F.col("sid").alias("source"), F.col("tid").alias("target"), none.alias("properties")).dropDuplicates(["id"])


def proposed_axioms(rows: DataFrame) -> DataFrame:
    """Axioms of proposals (kind, a, b) or (sub, sup)."""
    if "sub" in rows.columns:
        rows = rows.select(F.lit("SubClassOf").alias("kind"), F.col("sub").alias("a"), F.col("sup").alias("b"))
    return rows.select(axiom_id(F.col("kind"), F.col("a"), F.col("b")).alias("id"), "kind", "a", "b", F.lit(None).cast("string").alias("provenance")).dropDuplicates(["id"])


def json_value(text: Column) -> Column:
    """The value struct of a JSON text: text, integer, float, truth value, null, or JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    v = F.try_parse_json(text)
    scalar = lambda t: F.try_variant_get(v, "$", t)
    return (
        F.when(kind == "STRING", pv_of(scalar("string"), "string"))
        .when(kind == "BIGINT", pv_of(scalar("bigint"), "integer"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), pv_of(scalar("double"), "float"))
        .when(kind == "BOOLEAN", pv_of(scalar("boolean"), "bool"))
        .when(kind == "VOID", F.struct(F.lit("null").alias("t"), *(F.lit(None).cast(k).alias(n) for n, k in (("s", "string"), ("i", "bigint"), ("f", "double"), ("b", "boolean"), ("ts", "timestamp"), ("bin", "binary")))))
        .when(kind.isNotNull(), pv_of(F.to_json(v), "json"))
    )


def record_delta(records: DataFrame) -> Delta:
    """Nodes and edges of records (iri, type_name, properties of JSON texts, outbound pairs of label and iri); without iri an id is drawn."""
    props = F.transform_values("properties", lambda k, v: json_value(v))
    id_ = F.coalesce(node_id(F.col("iri")), random_id())
    nodes = records.select(id_.alias("id"), "iri", F.array_compact(F.array("type_name")).alias("types"), props.alias("properties"))
    out = records.where("iri is not null").select("iri", F.explode("outbound").alias("o"))
    source, target = node_id(F.col("iri")), node_id(F.get("o", F.lit(1)))
    none = F.lit(None).cast(nodes.schema["properties"].dataType)
    edges = out.select(edge_id(source, F.get("o", F.lit(0)), target).alias("id"), F.get("o", F.lit(0)).alias("label"), source.alias("source"), target.alias("target"), none.alias("properties"))
    return Delta(nodes, edges)


def records_table(records: DataFrame) -> DataFrame:
    """Records with their ids."""
    return records.withColumn("id", F.coalesce(record_id(F.col("iri")), random_id()))


class Session:
    """An agent's turns with tools until a stop: a tool named by the answer is called, and its result asked about next.

    An answer {"tool": name, "args": {...}} calls a tool.  ``stop`` says when it
    ends: ``no_tool`` with the first answer that calls none, ``json:key`` with
    the first answer that is JSON and has the key (in its first object, if it is
    a list), ``turns`` after ``max_turns`` whatever the answers are.  No session
    is longer than ``max_turns``.
    """

    def __init__(self, backend: Backend, tools: dict[str, Callable[..., object]], max_turns: int = 8, stop: str = "no_tool"):
        if stop not in ("no_tool", "turns") and not stop.startswith("json:"):
            raise ValueError(f"no such stop: {stop}")
        self.backend, self.tools, self.max_turns, self.stop = backend, tools, max_turns, stop
        self.calls: list[tuple[str, dict]] = []

    def _ends(self, answer: str, parsed: object, called: bool) -> bool:
        if self.stop == "turns":
            return False
        if self.stop == "no_tool":
            return not called
        first = parsed[0] if isinstance(parsed, list) and parsed else parsed
        return isinstance(first, dict) and self.stop.removeprefix("json:") in first

    def run(self, prompt: str) -> tuple[str, list[tuple[str, str]]]:
        """(final answer, transcript)."""
        transcript: list[tuple[str, str]] = []
        for _ in range(self.max_turns):
            answer = self.backend.complete(prompt)
            transcript.append((prompt, answer))
            try:
                parsed = json.loads(re.sub(r"^```\w*\s*|\s*```$", "", answer.strip()))
            except ValueError:
                parsed = None
            called = isinstance(parsed, dict) and parsed.get("tool") in self.tools
            if self._ends(answer, parsed, called):
                break
            prompt = f"{prompt}\n{answer}"
            if called:
                args = parsed.get("args", {})
                self.calls.append((parsed["tool"], args))
                prompt += f"\nresult: {json.dumps(self.tools[parsed['tool']](**args), default=str)}"
        return transcript[-1][1] if transcript else "", transcript


def induce(stage: str, subjects: list[str], session: Session, spark: SparkSession) -> tuple[DataFrame, Activity]:
    """Subclasses or axioms that an agent proposes after looking around with its tools, and the activity with its turns and calls; an answer that cannot be read proposes nothing."""
    lead, form = STAGES[stage]
    activity = Activity(f"{stage}-induction").with_attribute("backend", session.backend.label)
    answer, transcript = session.run(lead + json.dumps(subjects))
    rows = spark.createDataFrame([(answer,)], "answer string").select(F.explode(F.from_json(strip_fence(F.col("answer")), f"array<struct<{form}>>")).alias("r")).where("r is not null").select("r.*")
    return proposed_axioms(rows), activity.with_attribute("turns", len(transcript)).with_attribute("tool_calls", len(session.calls)).finish()


def store_tools(graph: Ontology) -> dict[str, Callable[..., object]]:
    """The questions an agent may ask of a graph's schema and instances, by name; answers are lists of texts, numbers and truth values."""
    names = lambda df: [r[0] for r in df.select("name").collect()]  # noqa: E731 - of the schema, or of one type
    return {
        "class_exists": lambda name: bool(store.class_exists(graph, name).first()[0]),
        "list_classes": lambda: names(store.list_classes(graph)),
        "list_edge_types": lambda: names(store.list_edge_types(graph)),
        "count_instances": lambda name: int(store.count_instances(graph, name).first()[0]),
        "subclasses_of": lambda name: names(store.subclasses_of(graph, name)),
        "supertypes_of": lambda name: names(store.supertypes_of(graph, name)),
        "properties_of_type": lambda name: names(store.properties_of_type(graph, name)),
    }
