"""Text graphs as DataFrames, and the given tables seen as corpora.

A corpus has typed nodes with features (one wide table for each node type, so that filters reach the scan) and
directed edges, valued or not. Node ids are positive and unique within a corpus: an offset for the type, the
row's key, and 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 10**12


class CorpusSource(Protocol):
    """What operators need from a corpus."""

    name: str

    def node_types(self) -> list[str]: ...
    def nodes(self, otype: str) -> DataFrame: ...
    def edge_names(self) -> list[str]: ...
    def edges(self, name: str) -> DataFrame: ...


@dataclass(frozen=True)
class EdgeType:
    """An edge: its end types, and the type of its value (None: unvalued)."""

    source: str
    target: str
    value_type: str | None = None


@dataclass
class TableCorpus:
    """A corpus from DataFrames: nodes by type (with a `node` column), edges by name (`src`, `dst`, `value`)."""

    name: str
    tables: dict[str, DataFrame]
    edge_types: dict[str, EdgeType] = field(default_factory=dict)
    edge_tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Types whose ids fill a range of their own, so that an id tells its type.
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)

    def node_types(self) -> list[str]:
        return sorted(self.tables)

    def nodes(self, otype: str) -> DataFrame:
        """Wide table of one node type; an unknown type is a KeyError, not an empty table."""
        return self.tables[otype]

    def edge_names(self) -> list[str]:
        return sorted(self.edge_tables)

    def edges(self, name: str) -> DataFrame:
        return self.edge_tables[name]

    def features(self, otype: str) -> list[str]:
        return [c for c in self.tables[otype].columns if c != "node"]


#: Type numbers: the order of the offsets.
TYPES = {
    "commerce": ("region", "nation", "supplier", "customer", "part", "order"),
    "activity": ("event", "user"),
    "library": ("document", "page", "turn", "item", "vector"),
}


def offset(corpus: str, otype: str) -> int:
    """Where the node ids of a type begin."""
    return (TYPES[corpus].index(otype)) * SPAN


def _numbered(df: DataFrame, corpus: str, otype: str, key: str) -> DataFrame:
    return df.withColumn("node", F.expr(f"CAST({key} AS BIGINT) + {offset(corpus, otype) + 1}L"))


def _edge(df: DataFrame, corpus: str, source: str, src: str, target: str, dst: str, value: str | None = None) -> DataFrame:
    ends = (f"CAST({c} AS BIGINT) + {offset(corpus, t) + 1}L AS {end}" for c, t, end in ((src, source, "src"), (dst, target, "dst")))
    return df.selectExpr(*ends, *([f"{value} AS value"] if value else []))


def commerce(spark: SparkSession, sf_dir: str) -> TableCorpus:
    """Orders, customers, parts and places. An order and a part have one edge, with the least flag and line."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "order": "o_orderkey"}
    raw = {t: read("orders" if t == "order" else t) for t in keys}
    line = read("lineitem")
    pairs = line.groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"), F.min("l_linenumber").alias("line"))
    return TableCorpus(
        "commerce",
        {t: _numbered(raw[t], "commerce", t, k) for t, k in keys.items()},
        {
            "order_customer": EdgeType("order", "customer"),
            "customer_nation": EdgeType("customer", "nation"),
            "supplier_nation": EdgeType("supplier", "nation"),
            "nation_region": EdgeType("nation", "region"),
            "order_part_flag": EdgeType("order", "part", "str"),
            "order_part_line": EdgeType("order", "part", "int"),
            "order_supplier": EdgeType("order", "supplier"),
        },
        {
            "order_customer": _edge(raw["order"], "commerce", "order", "o_orderkey", "customer", "o_custkey"),
            "customer_nation": _edge(raw["customer"], "commerce", "customer", "c_custkey", "nation", "c_nationkey"),
            "supplier_nation": _edge(raw["supplier"], "commerce", "supplier", "s_suppkey", "nation", "s_nationkey"),
            "nation_region": _edge(raw["nation"], "commerce", "nation", "n_nationkey", "region", "n_regionkey"),
            "order_part_flag": _edge(pairs, "commerce", "order", "l_orderkey", "part", "l_partkey", "flag"),
            "order_part_line": _edge(pairs, "commerce", "order", "l_orderkey", "part", "l_partkey", "line"),
            "order_supplier": _edge(line.select("l_orderkey", "l_suppkey").distinct(), "commerce", "order", "l_orderkey", "supplier", "l_suppkey"),
        },
        {t: (offset("commerce", t) + 1, offset("commerce", t) + SPAN) for t in keys},
    )


def activity(spark: SparkSession, sf_dir: str) -> TableCorpus:
    """Events and their users."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return TableCorpus(
        "activity",
        {"event": _numbered(events, "activity", "event", "event_id"), "user": _numbered(events.select("user_id").distinct(), "activity", "user", "user_id")},
        {"event_user": EdgeType("event", "user")},
        {"event_user": _edge(events, "activity", "event", "event_id", "user", "user_id")},
    )


def library(spark: SparkSession, sf_dir: str) -> TableCorpus:
    """Documents with labels as valued loops, pages, turns, benchmark items and vectors."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    labels = read("labels")
    pages = read("pages").withColumn("path_lang", F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1))
    return TableCorpus(
        "library",
        {
            "document": _numbered(read("documents"), "library", "document", "doc_id"),
            "page": _numbered(pages, "library", "page", "page_id"),
            "turn": _numbered(read("conversations"), "library", "turn", "conv_id * 1000 + turn"),
            "item": _numbered(read("benchmark"), "library", "item", "item_id"),
            "vector": _numbered(read("embeddings"), "library", "vector", "vec_id"),
        },
        {"quality": EdgeType("document", "document", "int"), "toxic": EdgeType("document", "document", "int")},
        {n: _edge(labels, "library", "document", "doc_id", "document", "doc_id", n) for n in ("quality", "toxic")},
    )


#: How each corpus is opened.
CORPORA = {"commerce": commerce, "activity": activity, "library": library}


def all_corpora(spark: SparkSession, sf_dir: str) -> dict[str, TableCorpus]:
    """The three corpora by name."""
    return {name: load(spark, sf_dir) for name, load in CORPORA.items()}
