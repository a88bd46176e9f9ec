"""Patterns of nodes and edges, and the plans built from them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

UNBOUNDED = None


@dataclass(frozen=True)
class NodePattern:
    """What a node must be: all types, all property values, any of ``alternatives``, none of ``excluded``."""

    name: str | None = None
    types: tuple[str, ...] = ()
    properties: tuple[tuple[str, Any], ...] = ()
    id: str | None = None
    alternatives: tuple[NodePattern, ...] = ()
    excluded: tuple[NodePattern, ...] = ()

    def bind(self, name: str) -> NodePattern:
        return replace(self, name=name)

    def typed(self, name: str) -> NodePattern:
        return replace(self, types=(*self.types, name))

    def with_property(self, key: str, value: Any) -> NodePattern:
        return replace(self, properties=(*((k, v) for k, v in self.properties if k != key), (key, value)))

    def with_id(self, id: str) -> NodePattern:
        return replace(self, id=id)

    def or_(self, other: NodePattern) -> NodePattern:
        return replace(self, alternatives=(*self.alternatives, other))

    def not_(self, other: NodePattern) -> NodePattern:
        return replace(self, excluded=(*self.excluded, other))


@dataclass(frozen=True)
class EdgePattern:
    """What an edge must be, and over how many of them a step goes: ``least`` to ``most``, None for any number."""

    name: str | None = None
    label: str | None = None
    properties: tuple[tuple[str, Any], ...] = ()
    least: int = 1
    most: int | None = 1

    def bind(self, name: str) -> EdgePattern:
        return replace(self, name=name)

    def labeled(self, label: str) -> EdgePattern:
        return replace(self, label=label)

    def with_property(self, key: str, value: Any) -> EdgePattern:
        return replace(self, properties=(*((k, v) for k, v in self.properties if k != key), (key, value)))

    def repeat(self, least: int, most: int | None) -> EdgePattern:
        if most is not None and most < least:
            raise ValueError(f"no such range: {least}..{most}")
        return replace(self, least=least, most=most)


@dataclass(frozen=True)
class Step:
    """One step of a traversal: along edges, to a node."""

    edge: EdgePattern
    target: NodePattern
    outbound: bool = True


@dataclass(frozen=True)
class TraversalPlan:
    """A seed, steps from it, and what is done with the rows: sort, skip, limit, project, in this order."""

    seed: NodePattern = field(default_factory=NodePattern)
    steps: tuple[Step, ...] = ()
    columns: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # (variable, descending)
    skipped: int = 0
    limited: int | None = None

    def out(self, edge: EdgePattern, target: NodePattern) -> TraversalPlan:
        return replace(self, steps=(*self.steps, Step(edge, target, True)))

    def in_(self, edge: EdgePattern, target: NodePattern) -> TraversalPlan:
        return replace(self, steps=(*self.steps, Step(edge, target, False)))

    def return_(self, *names: str) -> TraversalPlan:
        return replace(self, columns=names)

    def order_by(self, name: str) -> TraversalPlan:
        return replace(self, order=(*self.order, (name, False)))

    def order_by_desc(self, name: str) -> TraversalPlan:
        return replace(self, order=(*self.order, (name, True)))

    def skip(self, n: int) -> TraversalPlan:
        return replace(self, skipped=n)

    def limit(self, n: int) -> TraversalPlan:
        return replace(self, limited=n)
