"""Prerequisites: what a binding needs of a corpus, as pass, fail or unknown."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossgraph.operators.paths import value_domain
from glossgraph.operators.selectors import scalar_type
from glossgraph.plans import executor
from glossgraph.session import cut
from glossgraph.sources.graph import TableCorpus

RESULT = "node_type string, feature string, result string"


@dataclass(frozen=True)
class Dependency:
    """One need: its kind and what it names."""

    kind: str
    node_type: str = ""
    feature: str = ""
    edge: str = ""
    direction: str = "outgoing"
    value: object = None
    values: tuple = ()
    closed: bool = False
    target_type: str = ""
    steps: tuple = ()
    extent: str = ""


def feature_results(corpus: TableCorpus, needs: list[tuple[str, str]]) -> DataFrame:
    """(node_type, feature, result): pass if some node has a value, unknown if none of them has, fail if it isn't there.

    One aggregate for each node type, however many of its features are asked for.
    """
    spark = next(iter(corpus.tables.values())).sparkSession
    parts = []
    for otype in dict.fromkeys(t for t, _ in needs):
        features = [f for t, f in needs if t == otype]
        here = [f for f in features if otype in corpus.tables and f in corpus.tables[otype].columns]
        gone = [(otype, f, "fail") for f in features if f not in here]
        if gone:
            parts.append(spark.createDataFrame(gone, RESULT))
        if here:
            counts = corpus.nodes(otype).agg(F.count("*").alias("_all"), *(F.count(f).alias(f) for f in here))
            state = lambda f: F.when(F.col("_all") == 0, "fail").when(F.col(f) == 0, "unknown").otherwise("pass")
            parts.append(counts.select(F.inline(F.array(*(F.struct(F.lit(otype).alias("node_type"), F.lit(f).alias("feature"), state(f).alias("result")) for f in here)))))
    return functools.reduce(DataFrame.unionByName, parts)


def state(results: DataFrame, by: list[str], compatible: str = "verified-compatible") -> DataFrame:
    """Add the state of each key: a fail makes it incompatible, else an unknown makes it unverified."""
    any_of = lambda r: F.max((F.col("result") == r).cast("int"))
    states = results.groupBy(*by).agg(F.when(any_of("fail") == 1, "incompatible").when(any_of("unknown") == 1, "unverified").otherwise(compatible).alias("state"))
    return results.join(states, by)


def evaluate(corpus: TableCorpus, need: Dependency, components: dict[str, str] | None = None, extents: dict[str, str] | None = None) -> str:
    """One dependency: metadata first, and then at most one probe that Spark may stop early."""
    known_edge = need.edge in corpus.edge_types
    if need.kind == "component-present":
        return "pass" if (components or {}).get(need.feature) else "fail"
    if need.kind == "node-type-present":
        return "fail" if need.node_type not in corpus.tables or corpus.nodes(need.node_type).isEmpty() else "pass"
    if need.kind == "edge-present":
        return "pass" if known_edge and need.direction in ("outgoing", "incoming") else "fail"
    if need.kind == "path-present":
        return "pass" if need.steps and all(s in corpus.edge_types for s in need.steps) else "fail"
    if need.kind == "extent-interpretation":
        declared = (extents or {}).get(need.node_type)
        return "unknown" if declared is None else "pass" if declared == need.extent else "fail"
    if need.kind == "edge-value-domain":
        if not known_edge or corpus.edge_types[need.edge].value_type is None:
            return "fail"
        if any(scalar_type(v) != corpus.edge_types[need.edge].value_type for v in need.values):
            return "fail"
        seen = value_domain(corpus, need.edge, need.node_type, need.target_type).where(F.col("value").isNotNull() & ~F.col("value").isin(list(need.values)))
        return "pass" if seen.isEmpty() else "fail"
    if need.node_type not in corpus.tables or need.feature not in corpus.tables[need.node_type].columns:
        return "fail"
    filled = corpus.nodes(need.node_type).where(F.col(need.feature).isNotNull())
    if need.kind == "feature-present":
        return "unknown" if filled.isEmpty() else "pass"
    if need.kind == "native-value-present":
        return "fail" if filled.where(F.col(need.feature) == F.lit(need.value)).isEmpty() else "pass"
    if need.kind == "value-domain":
        values = list(need.values)
        if need.closed:  # all that is observed is reviewed
            return "pass" if filled.where(~F.col(need.feature).isin(values)).isEmpty() else "fail"
        present = filled.where(F.col(need.feature).isin(values)).agg(F.count_distinct(need.feature).alias("n")).first().n
        return "pass" if present == len(set(values)) else "fail"
    return "unknown"


def evaluate_all(spark: SparkSession, corpora: dict[str, TableCorpus], needs: DataFrame) -> DataFrame:
    """(corpus, dependency_id, result): pass, fail or unknown for any number of dependencies at once.

    `needs` has (corpus, dependency_id, kind, node_type, feature, edge, direction, value_type, values array, closed,
    target_type, steps array). Kinds that ask for schemas alone are joins with these; the others meet the corpora in one
    scan for each node type or edge that they name, however many they are: sizes of types and features in one
    aggregate, and values by a join with those that are asked for. Values are compared as text of the feature's type. A
    kind that isn't known is unknown where its feature is there, and fails elsewhere, as in evaluate().
    """
    types, features, edges = map(F.broadcast, executor.schemas(spark, corpora))  # as many rows as schemas have names
    there = types.withColumn("_type", F.lit(True))
    held = features.withColumnRenamed("kind", "_kind")
    linked = edges.select("corpus", "edge", F.lit(True).alias("_edge"), F.col("kind").alias("_edge_kind"))
    rows = cut(needs.join(there, ["corpus", "node_type"], "left").join(held, ["corpus", "node_type", "feature"], "left").join(linked, ["corpus", "edge"], "left"))
    names = lambda df, *c: sorted(tuple(r) for r in df.select(*c).distinct().collect())  # noqa: E731  (names of schemas)
    of_values = rows.where(F.col("kind").isin("native-value-present", "value-domain") & F.col("_kind").eqNullSafe(F.col("value_type")))
    by = ["corpus", "node_type", "feature"]

    counted, cells = [], executor.feature_values(corpora, names(of_values, *by))
    filled = names(rows.where("_kind IS NOT NULL"), *by)
    for name, otype in names(rows.where("_type"), "corpus", "node_type"):
        here = [f for c, t, f in filled if (c, t) == (name, otype)]
        sizes = corpora[name].nodes(otype).agg(F.count("*").alias("_all"), *(F.count(f"`{f}`").alias(f"n{k}") for k, f in enumerate(here)))
        each = [F.struct(F.lit(f).cast("string").alias("feature"), n.alias("_filled")) for f, n in [(None, F.lit(0).cast("long")), *((f, F.col(f"n{k}")) for k, f in enumerate(here))]]
        counted.append(sizes.select(F.lit(name).alias("corpus"), F.lit(otype).alias("node_type"), "_all", F.inline(F.array(*each))))
    if counted:
        sizes = functools.reduce(DataFrame.unionByName, counted)
        rows = rows.join(sizes.where("feature IS NULL").drop("feature", "_filled"), ["corpus", "node_type"], "left").join(sizes.where("feature IS NOT NULL").drop("_all"), by, "left")
    else:
        rows = rows.withColumns({"_all": F.lit(0), "_filled": F.lit(0)})

    met, outside = (spark.createDataFrame([], f"corpus string, dependency_id string, {c} long") for c in ("_met", "_outside"))
    if cells is not None:
        asked = of_values.select(*by, "dependency_id", "closed", "values")
        distinct = cut(cells.select(*by, "value").distinct())
        met = asked.select(*by, "dependency_id", F.explode(F.array_distinct("values")).alias("value")).join(distinct, [*by, "value"]).groupBy("corpus", "dependency_id").agg(F.count("*").alias("_met"))
        outside = asked.where("closed").join(distinct, by).where(~F.array_contains("values", F.col("value"))).groupBy("corpus", "dependency_id").agg(F.count("*").alias("_outside"))
    domains = [
        value_domain(corpora[c], e, s, t).select(F.lit(c).alias("corpus"), F.lit(e).alias("edge"), F.lit(s).alias("node_type"), F.lit(t).alias("target_type"), F.col("value").cast("string").alias("value"))
        for c, e, s, t in names(rows.where("kind = 'edge-value-domain' AND _edge_kind IS NOT NULL AND _type"), "corpus", "edge", "node_type", "target_type")
        if t in corpora[c].tables
    ]
    strange = spark.createDataFrame([], "corpus string, dependency_id string, _strange long")
    if domains:
        observed = functools.reduce(DataFrame.unionByName, domains).where("value IS NOT NULL")
        asked = rows.where("kind = 'edge-value-domain'").select("corpus", "edge", "node_type", "target_type", "dependency_id", "values")
        strange = asked.join(observed, ["corpus", "edge", "node_type", "target_type"]).where(~F.array_contains("values", F.col("value"))).groupBy("corpus", "dependency_id").agg(F.count("*").alias("_strange"))
    unknown_step = rows.where("kind = 'path-present'").select("corpus", "dependency_id", F.explode("steps").alias("edge")).join(linked.select("corpus", "edge"), ["corpus", "edge"], "left_anti")
    unknown_step = unknown_step.select("corpus", "dependency_id", F.lit(True).alias("_lost")).distinct()
    for found in (met, outside, strange, unknown_step):
        rows = rows.join(found, ["corpus", "dependency_id"], "left")

    ok = lambda c: F.when(c, "pass").otherwise("fail")
    typed = F.col("_kind").eqNullSafe(F.col("value_type"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    all_met = F.coalesce("_met", F.lit(0)) == F.size(F.array_distinct("values"))
    kind = F.col("kind")
    result = (
        F.when(kind == "node-type-present", ok(F.col("_type").isNotNull() & ~none("_all")))
        .when(kind == "edge-present", ok(F.col("_edge").isNotNull() & F.coalesce(F.col("direction").isin("outgoing", "incoming"), F.lit(False))))
        .when(kind == "path-present", ok((F.coalesce(F.size("steps"), F.lit(0)) > 0) & F.col("_lost").isNull()))
        .when(kind == "edge-value-domain", ok(F.col("_edge_kind").eqNullSafe(F.col("value_type")) & F.col("_edge_kind").isNotNull() & none("_strange")))
        .when(kind == "feature-present", F.when(F.col("_kind").isNull(), "fail").when(none("_filled"), "unknown").otherwise("pass"))
        .when(kind == "native-value-present", ok(typed & (F.size("values") == 1) & all_met))
        .when(kind == "value-domain", ok(typed & F.when(F.col("closed"), none("_outside")).otherwise(all_met)))
        .otherwise(F.when(F.col("_kind").isNull(), "fail").otherwise("unknown"))
    )
    return rows.select("corpus", "dependency_id", result.alias("result"))


def report(results: list[str], same_parent: bool = False, policy: str = "dependency-verified") -> str:
    """State of a corpus by its dependencies' results."""
    if "fail" in results:
        return "incompatible"
    if "unknown" in results:
        return "unverified"
    return "verified-exact" if same_parent else "verified-compatible" if policy == "dependency-verified" else "incompatible"


def problem(state: str) -> str | None:
    """Why a state refuses execution; None if it doesn't."""
    return {"incompatible": "prerequisite_incompatible", "unverified": "prerequisite_unverified"}.get(state)
