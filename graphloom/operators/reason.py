"""Forward chaining: what follows from axioms and edges.

Rules are joins.  Each pass joins only what the last pass has added with all
that is known, until a pass adds nothing; what is known is cut from its lineage
after every pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Ontology, axiom_id, edge_id
from graphloom.operators.store import Delta, apply_delta
from graphloom.session import cut

# a rule takes what is new and all that is known, and gives candidates;
# axioms are (kind, a, b), edges (label, source, target)
AxiomRule = Callable[[DataFrame, DataFrame], DataFrame]
EdgeRule = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


class ReasonerError(RuntimeError):
    """More passes were needed than allowed."""


def _chained(new: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """Pairs a -> c of a -> b -> c with a step of the new ones in it, a and c different."""
    left = lambda d: d.select(*by, F.col("a"), F.col("b").alias("mid"))
    right = lambda d: d.select(*by, F.col("a").alias("mid"), F.col("b").alias("c"))
    on = [*by, "mid"]
    both = left(new).join(right(known), on).unionByName(left(known).join(right(new), on))
    return both.where("a <> c").select(*by, "a", F.col("c").alias("b"))


def _of(axioms: DataFrame, kind: str) -> DataFrame:
    return axioms.where(F.col("kind") == kind)


def _swapped(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"))


def subclass_transitivity(new: DataFrame, known: DataFrame) -> DataFrame:
    return _chained(_of(new, "SubClassOf"), _of(known, "SubClassOf"), "kind")


def equivalent_symmetry(new: DataFrame, known: DataFrame) -> DataFrame:
    return _of(new, "EquivalentClass").select("kind", F.col("b").alias("a"), F.col("a").alias("b"))


def equivalent_to_subclass(new: DataFrame, known: DataFrame) -> DataFrame:
    same = _of(new, "EquivalentClass")
    return same.select(F.lit("SubClassOf").alias("kind"), "a", "b").unionByName(_swapped(same, "SubClassOf"))


def inverse_of_symmetry(new: DataFrame, known: DataFrame) -> DataFrame:
    return _of(new, "InverseOf").select("kind", F.col("b").alias("a"), F.col("a").alias("b"))


def property_symmetry(new: DataFrame, known: DataFrame, axioms: DataFrame) -> DataFrame:
    names = _of(axioms, "Symmetric").select(F.col("a").alias("label")).distinct()
    return new.join(names, "label", "left_semi").select("label", F.col("target").alias("source"), F.col("source").alias("target"))


def property_transitivity(new: DataFrame, known: DataFrame, axioms: DataFrame) -> DataFrame:
    names = _of(axioms, "Transitive").select(F.col("a").alias("label")).distinct()
    pairs = lambda d: d.join(names, "label", "left_semi").select("label", F.col("source").alias("a"), F.col("target").alias("b"))
    return _chained(pairs(new), pairs(known), "label").select("label", F.col("a").alias("source"), F.col("b").alias("target"))


def inverse_of_materializes(new: DataFrame, known: DataFrame, axioms: DataFrame) -> DataFrame:
    pairs = _of(axioms, "InverseOf").select("a", "b")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return new.join(pairs, F.col("label") == F.col("a")).select(F.col("b").alias("label"), F.col("target").alias("source"), F.col("source").alias("target"))


STANDARD_AXIOM_RULES: tuple[AxiomRule, ...] = (subclass_transitivity, equivalent_symmetry, equivalent_to_subclass, inverse_of_symmetry)
STANDARD_EDGE_RULES: tuple[EdgeRule, ...] = (property_symmetry, property_transitivity, inverse_of_materializes)


@dataclass(frozen=True)
class RuleSet:
    """Rules on axioms and rules on edges; ``standard`` has all seven."""

    axioms: tuple[AxiomRule, ...] = ()
    edges: tuple[EdgeRule, ...] = ()

    @staticmethod
    def standard() -> RuleSet:
        return RuleSet(STANDARD_AXIOM_RULES, STANDARD_EDGE_RULES)

    def with_axiom_rule(self, rule: AxiomRule) -> RuleSet:
        return RuleSet((*self.axioms, rule), self.edges)

    def with_edge_rule(self, rule: EdgeRule) -> RuleSet:
        return RuleSet(self.axioms, (*self.edges, rule))


@dataclass(frozen=True)
class Report:
    """What was derived, and in how many passes, the last empty one counted."""

    axioms: DataFrame
    edges: DataFrame
    passes: int


def _fixpoint(start: DataFrame, keys: list[str], step: Callable[[DataFrame, DataFrame], list[DataFrame]], most: int) -> tuple[DataFrame, int]:
    """All rows that are not in ``start`` and follow from it."""
    known = cut(start.select(*keys).distinct())
    new, derived, passes = known, known.where("false"), 0
    while True:
        passes += 1
        if passes > most:
            raise ReasonerError(f"no end after {most} passes")
        made = step(new, known)
        if not made:
            return derived, passes
        new = cut(_missing(reduce(DataFrame.unionByName, made).select(*keys).distinct(), known, keys))
        if new.isEmpty():
            return derived, passes
        derived, known = derived.unionByName(new), known.unionByName(new)


def _missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not known, nulls being equal."""
    n, k = rows.alias("n"), known.alias("k")
    return n.join(k, reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys)), "left_anti")


def run(graph: Ontology, rules: RuleSet | None = None, activity_id: str | None = None, most: int = 100, ordered: bool = True) -> Report:
    """What follows from the graph; it is not changed.  Derived axioms carry the activity's id, derived edges nothing; both come by id if ``ordered``."""
    rules, most = rules or RuleSet.standard(), max(1, most)
    axioms, p1 = _fixpoint(graph.axioms, ["kind", "a", "b"], lambda new, known: [r(new, known) for r in rules.axioms], most)
    all_axioms = graph.axioms.select("kind", "a", "b").unionByName(axioms)
    edges, p2 = _fixpoint(graph.edges, ["label", "source", "target"], lambda new, known: [r(new, known, all_axioms) for r in rules.edges], most)
    axiom_rows = axioms.select(axiom_id(F.col("kind"), F.col("a"), F.col("b")).alias("id"), "kind", "a", "b", F.lit(activity_id).cast("string").alias("provenance"))
    none = F.lit(None).cast(graph.edges.schema["properties"].dataType)
    edge_rows = edges.select(edge_id(F.col("source"), F.col("label"), F.col("target")).alias("id"), "label", "source", "target", none.alias("properties"))
    if ordered:
        axiom_rows, edge_rows = axiom_rows.orderBy("id"), edge_rows.orderBy("id")
    return Report(axiom_rows, edge_rows, max(p1, p2))


def materialize(graph: Ontology, rules: RuleSet | None = None, activity_id: str | None = None, most: int = 100) -> tuple[Ontology, Report]:
    """The graph with what follows from it."""
    report = run(graph, rules, activity_id, most, ordered=False)
    return apply_delta(graph, Delta(edges=report.edges, axioms=report.axioms), activity_id), report
