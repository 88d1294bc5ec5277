"""A mapping catalog that Spark derives from the given tables, so that catalog queries grow with them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from glossgraph.sources.catalog import MAPPING

#: (corpus, version, kind, relation, target prefix, node, feature, table, value as SQL); kinds node have no value.
DERIVED = (
    ("library", "1.2", "value", "exact", "urn:lang:", "document", "lang", "documents", "lang"),
    ("web", None, "value", "narrower", "urn:lang:", "page", "path_lang", "pages", "nullif(regexp_extract(url, '://[^/]+/([a-z][a-z])/', 1), '')"),
    ("library", "1.2", "value", "native-only", None, "document", "source", "documents", "source"),
    ("commerce", "1.10", "value", "exact", "urn:status:", "order", "o_orderstatus", "orders", "o_orderstatus"),
    ("logistics", None, "value", "exact", "urn:status:", "line", "l_linestatus", "lineitem", "l_linestatus"),
    ("logistics", "2.0", "value", "close", "urn:flag:", "line", "l_returnflag", "lineitem", "l_returnflag"),
    ("activity", "1.9", "value", "exact", "urn:event:", "event", "event_type", "events", "event_type"),
    ("audit", "1.0", "value", "broader", "urn:event:", "entry", "kind", "events", "event_type"),
    ("dialogue", "1.0", "value", "ambiguous", "urn:role:", "turn", "role", "conversations", "role"),
    ("commerce", "1.10", "value", "exact", "urn:priority:", "order", "o_orderpriority", "orders", "o_orderpriority"),
    ("commerce", None, "value", "unsupported", None, "order", "o_orderpriority", "orders", "CASE WHEN o_totalprice > 400000 THEN o_orderpriority END"),
    ("commerce", "1.2", "value", "close", "urn:segment:", "customer", "c_mktsegment", "customer", "c_mktsegment"),
    ("commerce", "1.10", "value", "exact", "urn:segment:", "customer", "c_mktsegment", "customer", "c_mktsegment"),
)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MAPPING rows of DERIVED: one for each distinct value."""
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    # a table is opened once, however many selectors it has
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in dict.fromkeys(row[7] for row in DERIVED)}
    parts = []
    for corpus, version, kind, relation, prefix, node, feature, table, value in DERIVED:
        values = tables[table].selectExpr(f"{value} AS value").distinct().where("value IS NOT NULL")
        row = {c: quoted(x) for c, x in (("corpus", corpus), ("source", table), ("corpus_version", version), ("kind", kind), ("relation", relation), ("node", node), ("feature", feature))}
        row |= {"target": f"'{prefix}' || value" if prefix else "NULL", "value": "value"}
        parts.append(values.selectExpr(*(f"CAST({row.get(c, 'NULL')} AS STRING) AS {c}" for c in MAPPING)))
    return functools.reduce(DataFrame.unionByName, parts)


def catalog_sql() -> str:
    """The same as a common table expression `m` for DuckDB."""
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    rows = [
        f"SELECT DISTINCT '{corpus}' AS corpus, '{table}' AS source, CAST({quoted(version)} AS VARCHAR) AS corpus_version, '{kind}' AS kind, '{relation}' AS relation, "
        f"{f"'{prefix}' || v" if prefix else 'CAST(NULL AS VARCHAR)'} AS target, '{node}' AS node, '{feature}' AS feature, v AS value "
        f"FROM (SELECT {value} AS v FROM {table}) WHERE v IS NOT NULL"
        for corpus, version, kind, relation, prefix, node, feature, table, value in DERIVED
    ]
    return "WITH m AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")"
