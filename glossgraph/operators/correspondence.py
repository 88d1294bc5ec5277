"""Lookups in a mapping catalog, correspondences of corpora through shared targets, and their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.operators.selectors import SelectionError, guarded_membership, text_value
from glossgraph.sources.catalog import APPROXIMATE, EXACT, SELECTOR
from glossgraph.sources.graph import TableCorpus


def _equal(df_column: str, value: str | None) -> Column:
    return F.col(df_column).eqNullSafe(F.lit(value).cast("string"))


def in_version(version: str | None, column: str = "corpus_version") -> Column:
    """Rows without a version hold in every version."""
    return F.lit(True) if version is None else F.col(column).isNull() | (F.col(column) == version)


def map_native(mappings: DataFrame, corpus: str, version: str | None = None, **selector: str) -> DataFrame:
    """Rows for one native selector; fields that aren't given must be null. A version keeps rows without one.

    Rows of several versions are refused without a version, no version being one; so are rows that are all of other
    versions than the given one.
    """
    if unknown := set(selector) - set(SELECTOR):
        raise SelectionError("selector", f"unknown fields {sorted(unknown)}")
    condition = F.col("corpus") == corpus
    for field in SELECTOR:
        condition = condition & _equal(field, selector.get(field))
    rows = mappings.where(condition)
    if version is None:
        return require_one_version(rows)
    kept = rows.where(in_version(version))
    if kept.isEmpty() and not rows.isEmpty():
        raise SelectionError("version_unverified", f"{corpus}: selector isn't verified for version {version}")
    return kept


def require_one_version(rows: DataFrame) -> DataFrame:
    """Refuse rows of several versions; a lookup without a version may not mix them."""
    versions = [r[0] for r in rows.select("corpus_version").distinct().limit(2).collect()]
    if len(versions) > 1:
        raise SelectionError("version_ambiguous", f"several versions match, {versions} among them")
    return rows


def positive(include_approximate: bool) -> Column:
    """Relations that match: exact ones, and approximate ones on request."""
    return F.col("relation").isin(*EXACT, *(APPROXIMATE if include_approximate else ()))


def find_by_target(mappings: DataFrame, target: str, corpus: str | None = None, kinds: tuple[str, ...] = ("node", "value"), include_approximate: bool = False) -> DataFrame:
    """Rows that express a target."""
    condition = (F.col("target") == target) & F.col("kind").isin(*kinds) & positive(include_approximate)
    return mappings.where(condition if corpus is None else condition & (F.col("corpus") == corpus))


def correspondences(mappings: DataFrame, source: str | None = None, target: str | None = None, include_approximate: bool = False, source_version: str | None = None, target_version: str | None = None) -> DataFrame:
    """Pairs of rows of different corpora with one kind and target.

    One output row for each pair of (corpus, selector): a_* and b_*, kind, target, both relations, how the pair
    is related, and its scope. Entities are candidates at most.
    """
    rows = mappings.where(positive(include_approximate) & F.col("target").isNotNull())
    side = lambda df, s: df.select("kind", "target", *(F.col(c).alias(f"{s}_{c}") for c in ("corpus", "relation", *SELECTOR[1:])))
    a = rows.where(in_version(source_version) & (F.lit(True) if source is None else F.col("corpus") == source))
    b = rows.where(in_version(target_version) & (F.lit(True) if target is None else F.col("corpus") == target))
    pairs = side(a, "a").join(side(b, "b"), ["kind", "target"]).where("a_corpus <> b_corpus")
    both = (F.col("a_relation") == "exact") & (F.col("b_relation") == "exact")
    entity = F.col("kind") == "entity"
    return pairs.withColumns(
        {
            "relation": F.when(entity, "unverified").when(both, "exact").otherwise("approximate-via-target"),
            "scope": F.when(entity, "entity-candidate").otherwise("category"),
        }
    )


def resolve_nodes(corpus: TableCorpus, rows: DataFrame, version: str | None = None) -> DataFrame:
    """Nodes of exact node and value rows of a corpus: (corpus, target, node).

    Value rows that share a node type and feature are answered by one join of the feature with the rows, so the
    work is one scan of a type, however many values its catalog lists.
    """
    rows = rows.where((F.col("corpus") == corpus.name) & (F.col("relation") == "exact") & in_version(version))
    # in one look: value rows by feature, which the schema bounds, and node rows with their targets
    heads = rows.where("kind IN ('node', 'value')").select("kind", "node", "feature", F.when(F.col("kind") == "node", F.col("target")).alias("target")).distinct().collect()
    features, guards = ([r for r in heads if r.kind == kind] for kind in ("value", "node"))
    parts = []
    for r in features:
        if r.node in corpus.tables and r.feature in corpus.tables[r.node].columns:
            wanted = rows.where((F.col("kind") == "value") & (F.col("node") == r.node) & (F.col("feature") == r.feature)).select("target", F.col("value").alias("_value")).distinct()
            nodes = corpus.nodes(r.node).select("node", F.col(r.feature).cast("string").alias("_value"))
            parts.append(nodes.join(wanted, "_value").select(F.lit(corpus.name).alias("corpus"), "target", "node"))
    for r in guards:
        if r.node in corpus.tables:
            parts.append(guarded_membership(corpus.nodes(r.node), r.feature).select(F.lit(corpus.name).alias("corpus"), F.lit(r.target).alias("target"), "node"))
    if not parts:
        raise SelectionError("nothing_to_resolve", f"no exact row of {corpus.name} has a loaded node type and feature")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes_of(corpus: TableCorpus, node: str, feature: str | None = None, value: str | None = None) -> DataFrame:
    """Nodes of one selector, values compared as text."""
    return guarded_membership(corpus.nodes(node), feature) if value is None else text_value(corpus.nodes(node), feature, value)
