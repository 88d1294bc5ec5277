"""From categories to plans: exact ones, approximate ones with accepted losses, and their execution.

A refusal is an error with a category, or in tables a status; it's never an empty answer. Two exact bindings
aren't united.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossgraph.operators import paths, selectors, sets
from glossgraph.operators.correspondence import in_version
from glossgraph.operators.selectors import SelectionError
from glossgraph.plans import bindings
from glossgraph.sources.catalog import RELATIONS
from glossgraph.sources.graph import TableCorpus

#: Losses of an approximation. broader here: the native meaning is within the target, so some of it is missed.
LOSSES = {"exact": (), "broader": ("undercoverage",), "narrower": ("overcoverage",), "close": ("overcoverage", "undercoverage")}


@dataclass(frozen=True)
class Plan:
    """A selector of one corpus for a target, with what it loses."""

    corpus: str
    target: str
    node: str
    feature: str | None = None
    values: tuple[str, ...] = ()
    steps: tuple[paths.Step, ...] = ()
    losses: tuple[str, ...] = ()

    @property
    def domain(self) -> tuple[str, str]:
        """Corpus and the type of the nodes that come out."""
        return self.corpus, self.steps[-1].result_type if self.steps else self.node


def with_losses(rows: DataFrame) -> DataFrame:
    """Add the losses of each row's relation."""
    losses = F.array().cast("array<string>")
    for relation, lost in LOSSES.items():
        losses = F.when(F.col("relation") == relation, F.array(*map(F.lit, lost)).cast("array<string>")).otherwise(losses)
    return rows.withColumn("losses", losses)


def choose(rows: DataFrame, accepted: list[str]) -> DataFrame:
    """(corpus, target, status, category): what resolving each target in each corpus gives.

    Rows of a catalog are bindings that are all eligible, unless a column `eligible` says otherwise.
    """
    eligible = F.col("eligible") if "eligible" in rows.columns else F.lit(True)
    row = F.to_json(F.struct(*(c for c in ("kind", "node", "feature", "value") if c in rows.columns)))
    bound = rows.where(F.col("target").isNotNull()).select("corpus", "target", F.col("relation").alias("assessment"), eligible.alias("eligible"), "losses", row.alias("projection_id"))
    return bindings.resolve(bound, ("target",), tuple(accepted)).select("corpus", "target", "status", "category")


def capability_facts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each relation for each key."""
    return rows.groupBy(*by).agg(F.count("*").alias("bindings"), *(F.sum((F.col("relation") == r).cast("int")).cast("long").alias(r.replace("-", "_")) for r in RELATIONS))


def _plan(row, losses: tuple[str, ...] = ()) -> Plan:
    return Plan(row.corpus, row.target, row.node, row.feature, (row.value,) if row.value is not None else (), losses=losses)


def resolve_exact(rows: DataFrame, corpus: str, targets: list[str], version: str | None = None) -> list[Plan]:
    """One plan for each target, in order; none or several exact rows are refused. Reads the catalog once."""
    if not targets or len(set(targets)) != len(targets):
        raise SelectionError("request", "targets must be distinct, and one at least")
    found = rows.where((F.col("corpus") == corpus) & F.col("target").isin(targets) & (F.col("relation") == "exact") & F.col("kind").isin("node", "value") & in_version(version)).collect()
    plans = []
    for target in targets:
        mine = [r for r in found if r.target == target]
        if not mine:
            raise SelectionError("no_exact_binding", f"{corpus} has no exact selector for {target}")
        if len(mine) > 1:
            raise SelectionError("multiple_exact_bindings", f"{corpus} has {len(mine)} for {target}")
        plans.append(_plan(mine[0]))
    return plans


def resolve_approximate(rows: DataFrame, corpus: str, target: str, accepted: tuple[str, ...], version: str | None = None) -> Plan:
    """The exact plan if there is one; else the only eligible approximation, if all its losses are accepted.

    Which refusal comes first is as in `bindings.resolve`: related rows never stand in, several approximations are
    refused whatever they lose, and losses are asked about last.
    """
    found = rows.where((F.col("corpus") == corpus) & (F.col("target") == target) & F.col("relation").isin(*LOSSES, "related") & F.col("kind").isin("node", "value") & in_version(version)).collect()
    exact = [r for r in found if r.relation == "exact"]
    if len(exact) > 1:
        raise SelectionError("multiple_exact_bindings", target)
    if exact:
        return _plan(exact[0])
    if not found:
        raise SelectionError("semantic_tuple_absent", target)
    stand_ins = [r for r in found if r.relation != "related"]
    if not stand_ins:
        raise SelectionError("non_substitutive_mapping", target)
    fitting = [r for r in stand_ins if getattr(r, "eligible", True)]
    if not fitting:
        raise SelectionError("approximation_not_authorized", target)
    if len(fitting) > 1:
        raise SelectionError("multiple_approximate_bindings", target)
    if not set(LOSSES[fitting[0].relation]) <= set(accepted):
        raise SelectionError("approximation_loss_not_accepted", target)
    return _plan(fitting[0], LOSSES[fitting[0].relation])


def execute(corpus: TableCorpus, plan: Plan) -> DataFrame:
    """Nodes of a plan: (node)."""
    if plan.node not in corpus.tables:
        raise SelectionError("node_type_missing", plan.node)
    table = corpus.nodes(plan.node)
    if plan.values:
        if plan.feature not in table.columns:
            raise SelectionError("feature_missing", str(plan.feature))
        start = table.where(F.col(plan.feature).cast("string").isin(list(plan.values))).select("node")
    else:
        start = selectors.guarded_membership(table, plan.feature)
    if not plan.steps:
        return start
    if start.isEmpty():  # an empty start is an error, an empty end an answer
        raise SelectionError("empty_start", plan.target)
    return paths.traverse(corpus, start, list(plan.steps))


def execute_conjunction(corpus: TableCorpus, plans: list[Plan]) -> tuple[DataFrame, tuple[str, ...]]:
    """Nodes in all plans, and the union of their losses."""
    nodes = sets.conjunction([(p.domain, execute(corpus, p)) for p in plans])
    return nodes, tuple(sorted(set(functools.reduce(tuple.__add__, (p.losses for p in plans)))))
