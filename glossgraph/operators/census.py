"""Census of a corpus: types, features, values and edges; and indexes of written forms."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossgraph.operators.selectors import present
from glossgraph.sources.graph import TableCorpus


def type_census(corpora: list[TableCorpus]) -> DataFrame:
    """(corpus, node_type, n)."""
    parts = [c.nodes(t).agg(F.count("*").alias("n")).select(F.lit(c.name).alias("corpus"), F.lit(t).alias("node_type"), "n") for c in corpora for t in c.node_types()]
    return functools.reduce(DataFrame.unionByName, parts)


def feature_census(corpus: TableCorpus, otype: str, features: list[str] | None = None) -> DataFrame:
    """(corpus, node_type, feature, raw, populated, empty, distinct): one pass over the type for all features."""
    features = features or corpus.features(otype)
    # distinct counts of several columns at once multiply the rows; turned around, each value is counted once
    pairs = corpus.nodes(otype).select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))))
    values = pairs.groupBy("feature", "value").agg(F.count("*").alias("n"))
    has = present("value")
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return values.groupBy("feature").agg(
        counted(F.col("value").isNotNull()).alias("raw"), counted(has).alias("populated"), counted(F.col("value") == "").alias("empty"), F.sum(F.when(has, 1).otherwise(0)).cast("long").alias("distinct")
    ).select(F.lit(corpus.name).alias("corpus"), F.lit(otype).alias("node_type"), "feature", "raw", "populated", "empty", "distinct")


def edge_census(corpus: TableCorpus) -> DataFrame:
    """(corpus, edge, source_type, target_type, value_type, n, n_values)."""
    parts = []
    for name in corpus.edge_names():
        kind, edges = corpus.edge_types[name], corpus.edges(name)
        values = F.count("value") if "value" in edges.columns else F.lit(0).cast("long")
        parts.append(
            edges.agg(F.count("*").alias("n"), values.alias("n_values")).select(
                F.lit(corpus.name).alias("corpus"), F.lit(name).alias("edge"), F.lit(kind.source).alias("source_type"), F.lit(kind.target).alias("target_type"), F.lit(kind.value_type).cast("string").alias("value_type"), "n", "n_values"
            )
        )
    return functools.reduce(DataFrame.unionByName, parts)


def top_values(nodes: DataFrame, feature: str, k: int = 20) -> DataFrame:
    """(value, n, rank): the k most frequent values, ties by the value. Only k rows leave each task."""
    counts = nodes.where(present(feature)).groupBy(F.col(feature).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def sampled_counts(nodes: DataFrame, by: str, sample: int = 3, order: str = "node") -> DataFrame:
    """For each value, how many nodes have it and the first few of them: a count, and a limited window, joined.

    The few come from a window that Spark limits before its shuffle, so no list of all nodes is made.
    """
    counts = nodes.groupBy(by).agg(F.count("*").alias("n"))
    ranked = nodes.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= sample)
    first = ranked.groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("first"))
    return counts.join(first, by)


def form_index(nodes: DataFrame, form: str, key: str = "node") -> DataFrame:
    """(form_hash, form_length, key, n): all nodes of written forms that several nodes share.

    Homographs stay apart as nodes: each has its row, and n says how many share its form.
    """
    hashed = nodes.select(F.sha2(form, 256).alias("form_hash"), F.length(form).alias("form_length"), key)
    shared = hashed.groupBy("form_hash", "form_length").agg(F.count("*").alias("n")).where("n > 1")
    return hashed.join(shared, ["form_hash", "form_length"])


def find_form(nodes: DataFrame, form: str, wanted: DataFrame) -> DataFrame:
    """Nodes with one of some written forms (a table with that column)."""
    return nodes.join(wanted.select(form).distinct(), form, "left_semi")


def domain_state(observed: DataFrame, reviewed: DataFrame, on: str = "value") -> DataFrame:
    """(closed, covered): whether all observed values are reviewed, and all reviewed ones observed."""
    both = observed.select(on, F.lit(1).alias("o")).distinct().join(reviewed.select(on, F.lit(1).alias("r")).distinct(), on, "full_outer")
    none = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)) == 0
    return both.agg(none(F.col("r").isNull()).alias("closed"), none(F.col("o").isNull()).alias("covered"))


def label(values: Column) -> Column:
    """One value, or mixed: and all of them."""
    return F.when(F.size(values) > 1, F.concat(F.lit("mixed:"), F.array_join(F.array_sort(values), "+"))).otherwise(F.element_at(values, 1))
