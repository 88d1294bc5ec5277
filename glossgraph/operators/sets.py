"""Set operations on node sets, and what losses say about comparing corpora."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.operators.selectors import SelectionError


def conjunction(atoms: list[tuple[tuple[str, str], DataFrame]]) -> DataFrame:
    """Nodes in every atom: ((component, node type), nodes). All atoms must share one domain; two at least."""
    if len(atoms) < 2:
        raise SelectionError("conjunction", "two atoms at least")
    if len({domain for domain, _ in atoms}) != 1:
        raise SelectionError("node_domain", "atoms select nodes of different domains")
    return functools.reduce(lambda a, b: a.join(b, "node", "left_semi"), [nodes for _, nodes in atoms]).distinct()


def union_losses(rows: DataFrame, by: list[str], losses: str = "losses") -> DataFrame:
    """Sorted distinct union of loss arrays for each key."""
    return rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(losses)))).alias(losses))


def comparison_state(plans: DataFrame, by: list[str], losses: str = "losses") -> DataFrame:
    """exactly- or approximately-comparable or heterogeneous-loss by the number of distinct loss sets that aren't empty."""
    shapes = F.count_distinct(F.when(F.size(losses) > 0, F.array_join(F.array_sort(F.array_distinct(losses)), "+")))
    state = F.when(shapes == 0, "exactly-comparable").when(shapes == 1, "approximately-comparable").otherwise("heterogeneous-loss")
    return plans.groupBy(*by).agg(state.alias("state"))


def subset_violations(part: DataFrame, whole: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `part` that `whole` lacks; empty if it's a subset."""
    return part.join(whole, on, "left_anti")


def disjointness_violations(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys in both."""
    return a.select(*on).distinct().join(b.select(*on), on, "left_semi")


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that were added, repeats counted."""
    return new.exceptAll(old)


def all_true(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__and__, conditions)


def inclusion(answer: DataFrame, target: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, extra, missed, state): what an answer has beyond its target and lacks of it."""
    both = answer.select(*by, key).distinct().withColumn("_a", F.lit(1)).join(target.select(*by, key).distinct().withColumn("_t", F.lit(1)), [*by, key], "full_outer")
    extra, missed = F.count(F.when(F.col("_t").isNull(), 1)), F.count(F.when(F.col("_a").isNull(), 1))
    state = F.when((extra > 0) & (missed > 0), "mixed").when(extra > 0, "overcoverage").when(missed > 0, "undercoverage").otherwise("exact")
    return both.groupBy(*by).agg(extra.alias("extra"), missed.alias("missed"), state.alias("state"))
