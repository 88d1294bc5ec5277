"""Registered queries over files: feature files, catalogs and manifests that Spark derives from the tables; each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossgraph.derived import DERIVED, catalog, catalog_sql
from glossgraph.registry import query, read
from glossgraph.session import shared_folder
from glossgraph.sources import catalog as catalogs
from glossgraph.sources import corpus_files, feature_files


def node_files(spark, sf_dir):
    """(file, pos, line): a node feature file for each document, with a range, a line that lacks its node, and a later node."""
    text = F.expr(
        "concat_ws('\n', CASE lang WHEN 'de' THEN '@nod' ELSE '@node' END, '@valueType=str', '',"
        " concat(10 * doc_id, '-', 10 * doc_id + length(source), '\t', lang), source, concat(10 * doc_id + 40, '\t', lang), '')"
    )
    files = read(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").cast("string").alias("file"), text.alias("text"))
    return feature_files.text_lines(files, "file", "text")


RANGES = """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS file, 10 * doc_id AS a, length(source) AS n, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
    r AS (SELECT file, a AS first, a + n AS last, lang AS value FROM f UNION ALL SELECT file, a + n + 1, a + n + 1, source FROM f UNION ALL SELECT file, a + 40, a + 40, lang FROM f)"""


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN lang <> 'de' THEN 'node' END AS marker, 'str' AS value_type, CASE WHEN lang = 'de' THEN 'marker' END AS problem
    FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"""
)
def feature_file_headers(spark, sf_dir):
    """What kind each feature file has; files without one kind are refused."""
    found = feature_files.headers(node_files(spark, sf_dir))
    return found.select("file", "marker", F.element_at("entries", F.lit("valueType")).alias("value_type"), "problem")


@query(RANGES + " SELECT file, first, last, value FROM r")
def feature_file_ranges(spark, sf_dir):
    """The ranges of nodes that a feature file's lines are about, implicit ones included."""
    return feature_files.ranges(node_files(spark, sf_dir))


@query(RANGES + " SELECT value, CAST(sum(last - first + 1) AS BIGINT) AS n FROM r GROUP BY value")
def feature_file_census(spark, sf_dir):
    """Nodes by value, from ranges alone."""
    return feature_files.type_counts(feature_files.ranges(node_files(spark, sf_dir)))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS file, src, dst, CAST(l_quantity AS VARCHAR) AS value
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS l_quantity, unnest([l_partkey, l_partkey + 1]) AS src FROM lineitem),
      (SELECT unnest([0, 1, 5]) AS step), LATERAL (SELECT l_suppkey + step AS dst)"""
)
def feature_file_edges(spark, sf_dir):
    """Edges of an edge feature file for each order: its lines name ranges and lists of nodes."""
    line = F.expr("concat(l_partkey, '-', l_partkey + 1, '\t', l_suppkey, '-', l_suppkey + 1, ',', l_suppkey + 5, '\t', cast(l_quantity AS long))")
    texts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    files = texts.select(F.col("l_orderkey").cast("string").alias("file"), F.concat(F.lit("@edge\n@edgeValues\n@valueType=int\n\n"), "body").alias("text"))
    return corpus_files.edge_rows(feature_files.text_lines(files, "file", "text"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
      e AS (SELECT *, l_orderkey % 2 = 0 AS valued, 100 + pos AS src FROM l)
    SELECT CAST(l_orderkey AS VARCHAR) AS file, src, dst, CASE WHEN valued THEN l_returnflag || chr(9) || q || chr(92) || 'n' || chr(10) END AS value FROM (SELECT *, unnest([l_suppkey + 1, l_suppkey + 2, l_suppkey + 7]) AS dst FROM e)"""
)
def feature_file_implicit_edges(spark, sf_dir):
    """Edge files of which the first line alone names its source; targets are lists, and values write tabs, line feeds and backslashes in two characters."""
    line, at = read(spark, sf_dir, "lineitem"), Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = line.withColumns({"at": F.row_number().over(at), "valued": F.col("l_orderkey") % 2 == 0})
    target = F.expr("concat(l_suppkey + 1, '-', l_suppkey + 2, ',', l_suppkey + 7)")
    value = F.concat("l_returnflag", F.lit("\\t"), F.col("l_quantity").cast("long"), F.lit("\\\\n\\n"))
    fields = F.concat_ws("\t", F.when(F.col("at") == 1, F.lit("101")), target, F.when(F.col("valued"), value))
    texts = line.groupBy("l_orderkey", "valued").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", fields.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = F.when(F.col("valued"), "@edge\n@edgeValues\n\n").otherwise("@edge\n\n")
    files = texts.select(F.col("l_orderkey").cast("string").alias("file"), F.concat(head, "body").alias("text"))
    return corpus_files.edge_rows(feature_files.text_lines(files, "file", "text", chunk=2))


@query("SELECT o_orderpriority AS file, o_orderkey + 1 AS first, o_orderkey + 1 AS last, o_orderstatus AS value FROM orders")
def feature_folder_ranges(spark, sf_dir):
    """Node feature files of orders by priority, written as text and read again in ranges of bytes: only lines after a gap name their node."""
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    # a line lacks its node where the order before has the same priority, which a join tells
    before = orders.select("o_orderpriority", (F.col("o_orderkey") + 1).alias("o_orderkey"), F.lit(True).alias("follows"))
    body = orders.join(before, ["o_orderpriority", "o_orderkey"], "left")
    text = F.when(F.col("follows"), F.col("o_orderstatus")).otherwise(F.concat((F.col("o_orderkey") + 1).cast("string"), F.lit("\t"), "o_orderstatus"))
    rows = body.select("o_orderpriority", F.col("o_orderkey").alias("at"), text.alias("value"))
    head = orders.select("o_orderpriority").distinct().select("o_orderpriority", F.inline(F.array(*(F.struct(F.lit(k - 9).cast("long").alias("at"), F.lit(x).alias("value")) for k, x in enumerate(("@node", "@valueType=str", ""))))))
    lines = rows.unionByName(head).withColumn("name", F.col("o_orderpriority"))
    lines.repartition("name").sortWithinPartitions("name", "at").select("value", "name").write.partitionBy("name").text(folder)
    found = feature_files.ranges(feature_files.lines(spark, f"{folder}/*/*"))
    return found.withColumn("file", F.url_decode(F.regexp_extract("file", "name=([^/]+)/", 1)))


@query(catalog_sql() + " SELECT corpus, source, corpus_version, kind, relation, target, node, feature, value FROM m")
def catalog_documents(spark, sf_dir):
    """The derived catalog, written as XML documents and read again; versions stand at rows, corpora at roots."""
    folder = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    attributes = ("kind", "relation", "target", "node", "feature", "value")
    rows = catalog(spark, sf_dir)
    for corpus, source in dict.fromkeys((d[0], d[7]) for d in DERIVED):
        one = rows.where((F.col("corpus") == corpus) & (F.col("source") == source))
        written = one.select(*(F.col(c).alias(f"_{c}") for c in attributes), F.col("corpus_version").alias("_corpusVersion"))
        root = f'mappings corpus="{corpus}" source="{source}"'
        written.write.format("xml").option("rootTag", root).option("rowTag", "map").option("declaration", "").save(f"{folder}/{corpus}-{source}")
    return catalogs.read_xml(spark, f"{folder}/*").select("corpus", "source", "corpus_version", *attributes)


@query(
    """SELECT n_name AS corpus_id, 'value:' || c_mktsegment AS item_id, 'value' AS kind, bool_or(c_acctbal > 9000) AS common_target, CAST(count(*) AS VARCHAR) AS n
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment"""
)
def coverage_documents(spark, sf_dir):
    """Coverage manifests, one JSON document for each nation, written and read again as items with their accounting."""
    folder = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    customers = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    items = customers.groupBy("n_name", "c_mktsegment").agg(F.bool_or(F.col("c_acctbal") > 9000).alias("common_target"), F.count("*").cast("string").alias("n"))
    layer = F.struct(F.array(F.lit("exact")).alias("assessments"), "common_target", F.array("n").alias("source_ids"))
    item = F.struct(F.concat(F.lit("value:"), "c_mktsegment").alias("item_id"), F.lit("value").alias("kind"), F.struct(layer.alias("production")).alias("accounting"))
    documents = items.groupBy(F.col("n_name").alias("corpus_id")).agg(F.collect_list(item).alias("semantic_items"))
    documents.write.option("maxRecordsPerFile", 1).json(folder)
    found = corpus_files.manifests(spark, folder)
    return found.select("corpus_id", "item_id", "kind", "production.common_target", F.get("production.source_ids", F.lit(0)).alias("n"))


@query(
    """WITH c AS (SELECT DISTINCT o_orderpriority AS corpus_id, CAST(year(o_orderdate) AS VARCHAR) AS release_id FROM orders),
      k AS (SELECT *, CASE WHEN corpus_id < '3' THEN release_id = max(release_id) OVER (PARTITION BY corpus_id) ELSE release_id >= '1997' END AS current FROM c),
      w AS (SELECT corpus_id, unnest(['current', '1995', '2050']) AS wanted FROM (SELECT DISTINCT corpus_id FROM c)),
      j AS (SELECT w.corpus_id, wanted, release_id, CASE wanted WHEN 'current' THEN current ELSE release_id = wanted END AS hit FROM w JOIN k USING (corpus_id)),
      g AS (SELECT corpus_id, wanted, count(*) FILTER (WHERE hit) AS n, min(release_id) FILTER (WHERE hit) AS release_id FROM j GROUP BY corpus_id, wanted)
    SELECT corpus_id, wanted, CASE WHEN n = 1 THEN release_id END AS release_id, CASE WHEN n = 0 THEN 'release_missing' WHEN n > 1 THEN 'release_ambiguous' END AS problem FROM g"""
)
def release_requests(spark, sf_dir):
    """Releases asked for by version or as current: found, missing or ambiguous."""
    years = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus_id"), F.year("o_orderdate").cast("string").alias("release_id")).distinct()
    newest = years.groupBy("corpus_id").agg(F.max("release_id").alias("newest"))
    current = F.when(F.col("corpus_id") < "3", F.col("release_id") == F.col("newest")).otherwise(F.col("release_id") >= "1997")
    known = years.join(newest, "corpus_id").select("corpus_id", "release_id", current.alias("current"))
    wanted = newest.select("corpus_id", F.explode(F.array(F.lit("current"), F.lit("1995"), F.lit("2050"))).alias("wanted"))
    return corpus_files.releases(known, wanted)


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS line_number, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
      h AS (SELECT *, last_value(nullif(regexp_extract(line, '^([A-Z][a-z]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number) AS section FROM l)
    SELECT doc_id, line_number, section, regexp_extract(line, '^([A-Za-z]+) ([a-z]+)', 1) AS code, regexp_extract(line, '^([A-Za-z]+) ([a-z]+)', 2) AS gloss
    FROM h WHERE section IS NOT NULL AND regexp_matches(line, '^([A-Za-z]+) ([a-z]+)')"""
)
def code_entries(spark, sf_dir):
    """Entries of texts as tables of codes, each under the last section line that comes before it or is it."""
    lines = corpus_files.numbered_lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    return corpus_files.codes(lines, "doc_id", "^([A-Z][a-z]+)", "^([A-Za-z]+) ([a-z]+)")
