"""Corpora, bundles and tables of codes from files, read by Spark's own readers.

A corpus is a folder of feature files: `otype` gives each node its type, node features give values for node ranges,
edge features give pairs. Ranges are joined to node types as ranges of each type, so nodes are made once, in the
type's wide table. Metadata documents (profiles, mappings, manifests) are JSON Lines or whole JSON files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossgraph.operators.selectors import SelectionError
from glossgraph.session import cut
from glossgraph.sources import feature_files
from glossgraph.sources.graph import EdgeType, TableCorpus

VALUE_TYPES = {"str": "string", "int": "long"}


def stem(file: Column) -> Column:
    """A file's name without its folder and suffix."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def edge_rows(numbered: DataFrame) -> DataFrame:
    """(file, src, dst, value): lines of edge files: `a<TAB>b`, with a third field if the header says @edgeValues.

    A line that has one field less lacks its source, which is then the node after that of the line before; a line of
    a target alone has no value, either. Node specs on either side may be ranges or lists; every pair of them is an edge.
    """
    parts = F.split("line", "\t")
    full = F.size(parts) == F.when(F.col("valued"), 3).otherwise(2)
    target = F.when(full, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    value = F.when(F.col("valued") & (F.size(parts) > 1), feature_files.unescaped(F.element_at(parts, -1)))
    parsed = feature_files.body(numbered).select(
        "file", "chunk", "pos", feature_files.spec_ranges(F.when(full, F.get(parts, F.lit(0)))).alias("sources"), feature_files.spec_ranges(target).alias("targets"), value.alias("value")
    )
    placed = feature_files.numbered_nodes(parsed.withColumn("given", F.array_max(F.transform("sources", lambda r: r["last"]))))
    nodes = lambda ranges: F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"])))
    ends = placed.select("file", F.explode(F.coalesce(nodes(F.col("sources")), F.array("node"))).alias("src"), nodes(F.col("targets")).alias("targets"), "value")
    return ends.select("file", "src", F.explode("targets").alias("dst"), "value")


def load(spark: SparkSession, folder: str, name: str, features: dict[str, str] | None = None) -> TableCorpus:
    """A corpus from a folder of feature files.

    Headers say which features there are and of what type; `features` may choose some of them, as
    {feature: "node" | "edge"}, and one that has no file is refused, as are a folder without `otype` and lines that
    can't be read. Files are read in ranges of bytes. Each type's table has its nodes with all node features that have a
    value there.
    """
    numbered = feature_files.lines(spark, f"{folder}/*.tf").withColumn("feature", stem(F.col("file")))
    heads = {r.feature: r for r in feature_files.headers(numbered).withColumn("feature", stem(F.col("file"))).collect()}  # one row for each file
    if problems := sorted(f for f, r in heads.items() if r.problem):
        raise SelectionError("feature_header", f"{problems}")
    if "otype" not in heads:
        raise SelectionError("otype_missing", folder)
    if gone := sorted(set(features or ()) - heads.keys()):
        raise SelectionError("feature_missing", f"{gone}")
    if bad := feature_files.malformed(numbered).first():
        raise SelectionError("feature_body", f"{bad.file}: {bad.problem} in {bad.line!r}")
    kinds = features or {f: r.marker for f, r in heads.items()}
    ranges = feature_files.ranges(numbered.where(F.col("feature").isin([f for f, k in kinds.items() if k == "node"]))).withColumn("feature", stem(F.col("file")))
    types = feature_files.nodes(ranges.where("feature = 'otype'")).select("node", F.col("value").alias("otype"))
    values = feature_files.nodes(ranges.where("feature <> 'otype'").withColumn("file", F.col("feature"))).select("node", F.col("file").alias("feature"), "value")
    placed = cut(values.join(types, "node"))  # each type reads it
    present = {}
    for r in placed.groupBy("otype", "feature").count().collect():  # as many rows as types have features
        present.setdefault(r.otype, []).append(r.feature)
    tables = {}
    for otype in sorted(r.otype for r in types.select("otype").distinct().collect()):
        nodes = types.where(F.col("otype") == otype).select("node")
        names = sorted(present.get(otype, []))
        if names:
            wide = placed.where(F.col("otype") == otype).groupBy("node").pivot("feature", names).agg(F.first("value"))
            for f in names:
                kind = VALUE_TYPES.get(heads[f].entries.get("valueType", "str") if f in heads and heads[f].entries else "str", "string")
                wide = wide.withColumn(f, F.col(f).cast(kind))
            nodes = nodes.join(wide, "node", "left")
        tables[otype] = nodes
    edge_types, edge_tables = {}, {}
    edges = edge_rows(numbered.where(F.col("feature").isin([f for f, k in kinds.items() if k == "edge"]))).withColumn("feature", stem(F.col("file")))
    for f, kind in kinds.items():
        if kind == "edge":
            entries = heads[f].entries or {}
            valued = "edgeValues" in entries
            rows = edges.where(F.col("feature") == f)
            value = entries.get("valueType", "str") if valued else None
            edge_tables[f] = rows.select("src", "dst", *([F.expr(f"try_cast(value AS {VALUE_TYPES[value]})").alias("value")] if valued else []))
            edge_types[f] = EdgeType("*", "*", value)
    return TableCorpus(name, tables, edge_types, edge_tables)


def reconciled(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(file, state) for files that a manifest (file, bytes, sha256) doesn't describe as they are, or describes without them."""
    there = feature_files.inventory(spark, f"{folder}/*").withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
    said = manifest.select("file", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    both = there.join(said, "file", "full_outer")
    state = F.when(F.col("bytes").isNull(), "missing").when(F.col("_bytes").isNull(), "undeclared").when((F.col("bytes") != F.col("_bytes")) | (F.col("sha256") != F.col("_sha256")), "changed")
    return both.select("file", state.alias("state")).where("state IS NOT NULL")


# Metadata documents


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one to a file, of a schema. What doesn't have it is refused when it's read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(corpus_id, item_id, kind, research, production) of coverage manifests; the accounting is null where there is none."""
    layer = "struct<assessments:array<string>,common_target:boolean,source_ids:array<string>>"
    schema = f"corpus_id string, semantic_items array<struct<item_id:string,kind:string,accounting:struct<research:{layer},production:{layer}>>>"
    items = documents(spark, path, schema).select("corpus_id", F.explode("semantic_items").alias("i"))
    return items.select("corpus_id", "i.item_id", "i.kind", "i.accounting.research", "i.accounting.production")


def profile_mappings(profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """(corpus_id, profile_version, mapping_id, …): mappings of the sources that each profile names in `mapping_sources`.

    A mapping that two sources of a profile have comes back twice; `violations.repeated_ids` finds it.
    """
    named = profiles.select("corpus_id", "profile_version", F.explode("mapping_sources").alias("source"))
    return named.join(sources, "source")


def bundle(tables: dict[str, DataFrame], corpus: str, version: str) -> dict[str, DataFrame]:
    """The rows of one corpus and profile version of each table; a bundle without a profile is refused."""
    one = lambda t: t.where((F.col("corpus_id") == corpus) & (F.col("profile_version") == version))
    if one(tables["profiles"]).isEmpty():
        raise SelectionError("bundle_missing", f"{corpus} {version}")
    return {n: one(t) for n, t in tables.items()}


def releases(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """(corpus_id, wanted, release_id, problem): releases that requests name by version, or as current.

    `catalogue` has (corpus_id, release_id, current); a request that meets no release, or several, has a problem.
    """
    joined = wanted.join(catalogue, "corpus_id", "left").withColumn("hit", F.when(F.col("wanted") == "current", F.col("current")).otherwise(F.col("release_id") == F.col("wanted")))
    n = F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0))
    found = joined.groupBy("corpus_id", "wanted").agg(n.alias("n"), F.min(F.when(F.col("hit"), F.col("release_id"))).alias("release_id"))
    problem = F.when(F.col("n") == 0, "release_missing").when(F.col("n") > 1, "release_ambiguous")
    return found.select("corpus_id", "wanted", F.when(F.col("n") == 1, F.col("release_id")).alias("release_id"), problem.alias("problem"))


# Tables of codes and ontologies


def blob_digest(content: Column) -> Column:
    """The digest under which version control keeps a file: SHA-1 of `blob`, its length, a zero byte and its bytes."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def pinned(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """(file, bytes, problem) of files whose size and blob digest are pinned (file, bytes, blob)."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("_bytes"), blob_digest(F.col("content")).alias("_blob"))
    joined = pins.join(files, "file", "left")
    problem = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_blob") != F.col("blob"), "digest")
    return joined.select("file", "bytes", problem.alias("problem"))


def numbered_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_number, line): the lines of texts, numbered from 1."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_number"), "line")


def codes(lines: DataFrame, key: str, section: str, entry: str) -> DataFrame:
    """(key, line_number, section, code, gloss): entries with the nearest section line before them; both are patterns with groups."""
    head = F.regexp_extract("line", section, 1)
    window = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    gated = lines.withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(window))
    code = F.regexp_extract("line", entry, 1)
    return gated.where((code != "") & F.col("section").isNotNull()).select(key, "line_number", "section", code.alias("code"), F.regexp_extract("line", entry, 2).alias("gloss"))


def ontology_classes(spark: SparkSession, path: str, row: str = "owl:Class") -> DataFrame:
    """(iri, parent): classes of an OWL document with their direct parents; null where there are none."""
    schema = "`_rdf:about` string, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>"
    rows = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    parents = F.filter(F.transform(F.coalesce("rdfs:subClassOf", F.array().cast("array<struct<`_rdf:resource`:string>>")), lambda x: x["_rdf:resource"]), lambda x: x.isNotNull())
    return rows.where(F.col("`_rdf:about`").isNotNull()).select(F.col("`_rdf:about`").alias("iri"), F.explode_outer(parents).alias("parent"))
