"""Edge paths: fixed-length walks with directions, target types and reviewed edge values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossgraph.operators.selectors import SelectionError, scalar_type
from glossgraph.sources.graph import TableCorpus


@dataclass(frozen=True)
class Step:
    """One hop: an edge, its direction, the type that neighbours must have, and values that it may carry."""

    edge: str
    result_type: str
    direction: str = "outgoing"
    match_values: tuple = ()


def check(corpus: TableCorpus, steps: list[Step]) -> None:
    """Refuse a path before anything is read: unknown edges, types and directions, values of another type."""
    if not steps:
        raise SelectionError("path_empty", "a path has one step at least")
    for step in steps:
        if step.edge not in corpus.edge_types:
            raise SelectionError("edge_missing", step.edge)
        if step.result_type not in corpus.tables:
            raise SelectionError("node_type_missing", step.result_type)
        if step.direction not in ("outgoing", "incoming"):
            raise SelectionError("direction", step.direction)
        kind = corpus.edge_types[step.edge].value_type
        if step.match_values and kind is None:
            raise SelectionError("edge_unvalued", step.edge)
        if any(scalar_type(v) != kind for v in step.match_values):
            raise SelectionError("value_type", f"{step.edge} holds {kind}")


def hop(corpus: TableCorpus, frontier: DataFrame, step: Step) -> DataFrame:
    """Rows (src, dst[, value]) from a distinct frontier; a null value never matches, an empty string may.

    Types whose ids lie in a range are told by it; others by a join with their nodes.
    """
    edges = corpus.edges(step.edge)
    if step.direction == "incoming":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c == "value"))
    if step.match_values:
        edges = edges.where(F.col("value").isin(list(step.match_values)))
    typed = of_type(corpus, edges, "dst", step.result_type)
    return typed.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi")


def of_type(corpus: TableCorpus, edges: DataFrame, end: str, otype: str) -> DataFrame:
    """Edges whose one end is of a type."""
    if otype in corpus.ranges:
        low, high = corpus.ranges[otype]
        return edges.where(F.col(end).between(low, high))
    return edges.join(corpus.nodes(otype).select(F.col("node").alias(end)), end, "left_semi")


def dangling(corpus: TableCorpus, edge: str) -> DataFrame:
    """(dangling, edges): how many edges there are, and of how many an end isn't a node of the edge's type."""
    kind, edges = corpus.edge_types[edge], corpus.edges(edge)
    ends = edges
    for end, otype in (("src", kind.source), ("dst", kind.target)):
        ends = ends.join(corpus.nodes(otype).select(F.col("node").alias(end), F.lit(1).alias(f"_{end}")), end, "left")
    gone = F.col("_src").isNull() | F.col("_dst").isNull()
    return ends.agg(F.coalesce(F.sum(gone.cast("long")), F.lit(0)).alias("dangling"), F.count("*").alias("edges"))


def traverse(corpus: TableCorpus, start: DataFrame, steps: list[Step]) -> DataFrame:
    """Distinct nodes at the end of a path. The frontier is made distinct at each hop, so walks don't multiply."""
    check(corpus, steps)
    frontier = start.select("node").distinct()
    for step in steps:
        frontier = hop(corpus, frontier, step).select(F.col("dst").alias("node")).distinct()
    return frontier


def evidence(corpus: TableCorpus, start: DataFrame, steps: list[Step]) -> DataFrame:
    """Every edge that a walk kept, as it is stored: step (from 0), src, dst, value_present, value as text.

    Fan-in isn't made distinct. A step that walks against its edge keeps the edge's own direction.
    """
    check(corpus, steps)
    frontier, layers = start.select("node").distinct(), None
    for k, step in enumerate(steps):
        kept = hop(corpus, frontier, step)
        value = F.col("value").cast("string") if "value" in kept.columns else F.lit(None).cast("string")
        src, dst = ("src", "dst") if step.direction == "outgoing" else ("dst", "src")
        layer = kept.select(F.lit(k).alias("step"), F.col(src).alias("src"), F.col(dst).alias("dst"), value.isNotNull().alias("value_present"), value.alias("value"))
        layers = layer if layers is None else layers.unionByName(layer)
        frontier = kept.select(F.col("dst").alias("node")).distinct()
    return layers


def discovery_order(corpus: TableCorpus, start: DataFrame, steps: list[Step]) -> DataFrame:
    """(node, ord): nodes at the end, and arrays that sort as a walk meets them that takes neighbours by their ids.

    The walk begins at `start` in the order of its ids, or of `ord` if it has that column. A node is met first from
    the first source that has it, so its array is that source's with its own id added, and the least one counts. No
    task ranks all nodes.
    """
    check(corpus, steps)
    begin = F.col("ord") if "ord" in start.columns else F.col("node")
    frontier = start.select("node", F.array(begin.cast("long")).alias("ord"))
    for step in steps:
        kept = hop(corpus, frontier.select("node"), step).join(frontier.withColumnRenamed("node", "src"), "src")
        frontier = kept.groupBy(F.col("dst").alias("node")).agg(F.min("ord").alias("ord"))
        frontier = frontier.select("node", F.concat("ord", F.array("node")).alias("ord"))
    return frontier


def duplicate_pairs(edges: DataFrame) -> DataFrame:
    """Pairs that an edge has more than once; a valued edge with any is refused by its readers."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def value_domain(corpus: TableCorpus, edge: str, source: str, target: str) -> DataFrame:
    """(value, n): values between two node types, null for edges without one."""
    ends = of_type(corpus, of_type(corpus, corpus.edges(edge), "src", source), "dst", target)
    return ends.groupBy("value").agg(F.count("*").alias("n"))
