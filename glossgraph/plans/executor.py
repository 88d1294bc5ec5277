"""Execution of compiled selectors of all shapes: plans are rows, and any number of them advance in the same joins.

A plan is a membership, a value predicate, a value-set predicate or an edge path over one corpus. Plans that select the
same have one answer, whatever their number. Value plans meet the features that they name in one join of values. Edge
paths are walked together: plans that begin alike share a frontier, which is a relation of (path, node); a step joins it
with the moves that paths make next, with the edges of all names and directions, and with the types of nodes. So the
number of joins is that of the longest path's steps, and not that of the plans.

Schemas (types, features, edges) are small tables; nothing else goes through the driver.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossgraph.operators.selectors import SQL_TYPES
from glossgraph.session import cut
from glossgraph.sources.graph import TableCorpus

SHAPES = ("membership", "value-predicate", "value-set-predicate", "edge-path")
DIRECTIONS = ("outgoing", "incoming")
_STEPS = "array<struct<step:int,edge:string,direction:string,result_type:string,match_values:array<string>,match_type:string>>"


@dataclass(frozen=True)
class Execution:
    """plans: (corpus, plan_id, answer, problem), just one of the last two; nodes: (answer, node), distinct; evidence: the
    edges that walks kept, (path, step, src, dst, value_present, value) as they are stored; paths: (answer, step, path)."""

    plans: DataFrame
    nodes: DataFrame
    evidence: DataFrame
    paths: DataFrame


def _kind(column_type: object) -> str | None:
    return next((k for k, types in SQL_TYPES.items() if isinstance(column_type, types)), None)


def schemas(spark: SparkSession, corpora: dict[str, TableCorpus]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, node_type), (corpus, node_type, feature, kind) and (corpus, edge, kind): as many rows as the schemas have names."""
    types = [(n, t) for n, c in corpora.items() for t in c.node_types()]
    features = [(n, t, f.name, _kind(f.dataType)) for n, c in corpora.items() for t in c.node_types() for f in c.nodes(t).schema if f.name != "node"]
    edges = [(n, e, k.value_type) for n, c in corpora.items() for e, k in c.edge_types.items()]
    return (
        spark.createDataFrame(types, "corpus string, node_type string"),
        spark.createDataFrame(features, "corpus string, node_type string, feature string, kind string"),
        spark.createDataFrame(edges, "corpus string, edge string, kind string"),
    )


def gathered(selectors: DataFrame, values: DataFrame, steps: DataFrame) -> DataFrame:
    """Plans with their values and steps as arrays: (corpus, plan_id, shape, node_type, feature, values, steps).

    `values` has (corpus, plan_id, value, value_type), `steps` (corpus, plan_id, step from 0, edge, direction,
    result_type, match_values array or null, match_type). Both are parts of one reviewed selector each.
    """
    by = ["corpus", "plan_id"]
    valued = values.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("value_type", "value"))).alias("values"))
    walked = steps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), "edge", "direction", "result_type", "match_values", "match_type"))).alias("steps"))
    return selectors.join(valued, by, "left").join(walked, by, "left").withColumns(
        {"values": F.coalesce("values", F.array().cast("array<struct<value_type:string,value:string>>")), "steps": F.coalesce("steps", F.array().cast(_STEPS))}
    )


def problems(plans: DataFrame, types: DataFrame, features: DataFrame, edges: DataFrame) -> DataFrame:
    """Plans with `problem`: the first reason why one isn't executable, null if it is; nothing of a corpus is read for it.

    Asked in this order: the corpus, the shape, the type; the feature, its values and their type; the steps, their
    edges, result types, directions, and the values that they match.
    """
    known = types.select("corpus", "node_type", F.lit(True).alias("_typed"))
    loaded = types.select("corpus").distinct().withColumn("_loaded", F.lit(True))
    held = features.withColumnRenamed("kind", "_kind")
    step = plans.select("corpus", "plan_id", F.explode("steps").alias("s")).select("corpus", "plan_id", "s.*")
    step = step.join(edges.select("corpus", "edge", F.lit(True).alias("_edge"), F.col("kind").alias("_value")), ["corpus", "edge"], "left")
    step = step.join(types.select("corpus", F.col("node_type").alias("result_type"), F.lit(True).alias("_result")), ["corpus", "result_type"], "left")
    matched = F.col("match_values").isNotNull()
    why = (
        F.when(F.col("_edge").isNull(), "edge_missing")
        .when(F.col("_result").isNull(), "node_type_missing")
        .when(~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "direction")
        .when(matched & F.col("_value").isNull(), "edge_unvalued")
        .when(matched & ((F.size("match_values") == 0) | (F.size("match_values") != F.size(F.array_distinct("match_values")))), "value_set")
        .when(matched & ~F.col("match_type").eqNullSafe(F.col("_value")), "value_type")
    )
    stepped = step.groupBy("corpus", "plan_id").agg(F.min_by(why, F.when(why.isNotNull(), F.col("step"))).alias("_step_problem"), F.array_sort(F.collect_list("step")).alias("_numbers"))
    joined = plans.join(loaded, "corpus", "left").join(known, ["corpus", "node_type"], "left").join(held, ["corpus", "node_type", "feature"], "left").join(stepped, ["corpus", "plan_id"], "left")
    n, shape = F.size("values"), F.col("shape")
    of_value = (
        F.when(F.col("_kind").isNull(), "feature_missing")
        .when((n == 0) | ((shape == "value-predicate") & (n > 1)) | (n != F.size(F.array_distinct("values"))), "value_set")
        .when(F.exists("values", lambda v: ~v["value_type"].eqNullSafe(F.col("_kind")) | v["value"].isNull()), "value_type")
    )
    of_path = F.when(F.size("steps") == 0, "path_empty").when(F.col("_numbers") != F.sequence(F.lit(0), F.size("steps") - 1), "path_order").otherwise(F.col("_step_problem"))
    problem = (
        F.when(F.col("_loaded").isNull(), "missing_execution_component")
        .when(~F.coalesce(shape.isin(*SHAPES), F.lit(False)), "unsupported_native_binding")
        .when(F.col("_typed").isNull(), "node_type_missing")
        .when(shape.isin("value-predicate", "value-set-predicate"), of_value)
        .when(shape == "edge-path", of_path)
    )
    return joined.select(*plans.columns, problem.alias("problem"))


def _identity(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def _path(steps: Column) -> Column:
    """What identifies the beginning of a walk: corpus, start and steps."""
    return _identity("corpus", "node_type", steps.alias("steps"))


def feature_values(corpora: dict[str, TableCorpus], wanted: list[tuple[str, str, str]]) -> DataFrame | None:
    """(corpus, node_type, feature, value, node) of the features that plans name; each table is read once, with these columns alone."""
    parts = []
    for name, otype in dict.fromkeys((c, t) for c, t, _ in wanted):
        named = [f for c, t, f in wanted if (c, t) == (name, otype)]
        cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("value")) for f in named)))
        rows = corpora[name].nodes(otype).select("node", cells.alias("cell")).where("cell.value IS NOT NULL")
        parts.append(rows.select(F.lit(name).alias("corpus"), F.lit(otype).alias("node_type"), "cell.feature", "cell.value", "node"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def typed_nodes(corpora: dict[str, TableCorpus], wanted: list[tuple[str, str]]) -> DataFrame | None:
    """(corpus, node_type, node) of some types."""
    parts = [corpora[c].nodes(t).select(F.lit(c).alias("corpus"), F.lit(t).alias("node_type"), "node").distinct() for c, t in wanted]
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def moving_edges(corpora: dict[str, TableCorpus], wanted: list[tuple[str, str, str]]) -> DataFrame | None:
    """(corpus, edge, direction, node, next, value) of the edges that paths walk, turned round where they walk against them."""
    parts = []
    for c, e, direction in wanted:
        edges = corpora[c].edges(e)
        here, there = ("src", "dst") if direction == "outgoing" else ("dst", "src")
        value = F.col("value").cast("string") if "value" in edges.columns else F.lit(None).cast("string")
        parts.append(edges.select(F.lit(c).alias("corpus"), F.lit(e).alias("edge"), F.lit(direction).alias("direction"), F.col(here).alias("node"), F.col(there).alias("next"), value.alias("value")))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def execute(spark: SparkSession, corpora: dict[str, TableCorpus], plans: DataFrame) -> Execution:
    """Answers of all plans (as from gathered()); plans with a problem have none, and an empty answer is no problem.

    An edge path whose start type has no nodes is refused (invalid_result_nodes). Frontiers are distinct at each
    step. A null edge value never matches, and values are compared as their own type writes them.
    """
    types, features, edges = schemas(spark, corpora)
    judged = problems(plans, *map(F.broadcast, (types, features, edges)))  # as many rows as schemas have names
    is_path, is_value = F.col("shape") == "edge-path", F.col("shape").isin("value-predicate", "value-set-predicate")
    answer = F.when(is_path, _path(F.col("steps"))).when(is_value, _identity("corpus", "node_type", "feature", "values")).otherwise(_identity("corpus", "node_type"))
    judged = cut(judged.withColumn("answer", F.when(F.col("problem").isNull(), answer)))
    good = judged.where("problem IS NULL").dropDuplicates(["answer"])
    names = lambda rows, *columns: sorted(tuple(r) for r in rows.select(*columns).distinct().collect())  # noqa: E731  (names of schemas)
    found = []

    wanted = names(good.where("shape = 'membership'"), "corpus", "node_type")
    if wanted:
        found.append(good.where("shape = 'membership'").select("answer", "corpus", "node_type").join(typed_nodes(corpora, wanted), ["corpus", "node_type"]).select("answer", "node"))
    wanted = names(good.where(is_value), "corpus", "node_type", "feature")
    if wanted:
        asked = good.where(is_value).select("answer", "corpus", "node_type", "feature", F.explode("values.value").alias("value"))
        found.append(asked.join(feature_values(corpora, wanted), ["corpus", "node_type", "feature", "value"]).select("answer", "node").distinct())

    walks = good.where(is_path)
    starts = names(walks, "corpus", "node_type")
    none = spark.createDataFrame([], "path string, step int, src long, dst long, value_present boolean, value string")
    evidence, layers = none, []
    upto = lambda k: _path(F.slice("steps", 1, k)) if isinstance(k, int) else _path(F.slice(F.col("steps"), F.lit(1), k))
    paths = walks.select("answer", "corpus", "node_type", "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("step"))
    paths = paths.select("answer", (F.col("step") - 1).alias("step"), upto(F.col("step")).alias("path"))
    if starts:
        moves = walks.select("corpus", "node_type", "steps", F.explode("steps").alias("s"))
        moves = moves.select(
            "corpus", upto(F.col("s.step")).alias("parent"), upto(F.col("s.step") + 1).alias("path"), "s.step", "s.edge", "s.direction", "s.result_type", "s.match_values"
        ).dropDuplicates(["path"])
        moves = cut(moves)
        turned = moving_edges(corpora, names(moves, "corpus", "edge", "direction"))
        ends = typed_nodes(corpora, names(moves, "corpus", "result_type")).withColumnsRenamed({"node_type": "result_type", "node": "next"})
        begin = walks.select("corpus", "node_type", upto(0).alias("path")).distinct()
        frontier = cut(begin.join(typed_nodes(corpora, starts), ["corpus", "node_type"]).select("path", "node"))
        first = frontier.select("path").distinct()
        for k in range(moves.agg(F.max("step")).first()[0] + 1):
            step = moves.where(F.col("step") == k).withColumnRenamed("path", "_path")
            ahead = frontier.withColumnRenamed("path", "parent").join(step, "parent").join(turned, ["corpus", "edge", "direction", "node"])
            ahead = ahead.where(F.col("match_values").isNull() | F.coalesce(F.array_contains("match_values", F.col("value")), F.lit(False)))
            kept = cut(ahead.join(ends, ["corpus", "result_type", "next"], "left_semi").select(F.col("_path").alias("path"), "step", "direction", "node", "next", "value"))
            outgoing = F.col("direction") == "outgoing"
            src, dst = F.when(outgoing, F.col("node")).otherwise(F.col("next")), F.when(outgoing, F.col("next")).otherwise(F.col("node"))
            evidence = evidence.unionByName(kept.select("path", "step", src.alias("src"), dst.alias("dst"), F.col("value").isNotNull().alias("value_present"), "value"))
            frontier = cut(kept.select("path", F.col("next").alias("node")).distinct())
            layers.append(frontier)
        last = walks.select("answer", _path(F.col("steps")).alias("path"))
        found.append(functools.reduce(DataFrame.unionByName, layers).join(last, "path").select("answer", "node"))
        started = walks.select("answer", upto(0).alias("path")).join(first, "path", "left_semi").select("answer", F.lit(True).alias("_started"))
        judged = judged.join(started, "answer", "left")
        empty = is_path & F.col("problem").isNull() & F.col("_started").isNull()
        judged = judged.withColumns({"problem": F.when(empty, "invalid_result_nodes").otherwise(F.col("problem")), "answer": F.when(~empty, F.col("answer"))})
    nodes = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "answer string, node long")
    return Execution(judged.select("corpus", "plan_id", "answer", "problem"), nodes, evidence, paths)
