"""Registered queries over digests of documents and walks, and over dependencies of bindings; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossgraph.bundles import table, with_tables
from glossgraph.functions import digests
from glossgraph.plans import prerequisites
from glossgraph.registry import query, read
from glossgraph.sources.graph import commerce

JSON = {"ignoreNullFields": "false"}
NUMBER = "CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END"


@query(
    with_tables("projections", "mappings")
    + f""", p AS (SELECT mapping_id, string_agg('{{"losses":[' || CASE WHEN losses = '' THEN '' ELSE '"' || replace(losses, '+', '","') || '"' END || '],"projection_id":"' || projection_id || '","target":"' || target || '"}}', ',' ORDER BY projection_id) AS parts FROM projections GROUP BY 1)
    SELECT p_partkey, 'sha256:' || sha256('{{"mapping_id":"p' || p_partkey || '","native":{{"feature":"label","node_type":"part","value":' || coalesce('"' || m.value || '"', 'null') || '}},"price":' || {NUMBER} || ',"profiles":["a","z"],"projections":[' || coalesce(parts, '') || '],"size":' || p_size || ',"é":true}}') AS digest,
      CAST(NULL AS VARCHAR) AS problem FROM part JOIN mappings m ON m.mapping_id = 'p' || p_partkey LEFT JOIN p USING (mapping_id)"""
)
def mapping_digests(spark, sf_dir):
    """Digests of mappings' meaning from a column of JSON: keys, lists and audit fields as they come make no difference."""
    projections = table(spark, sf_dir, "projections").where("corpus = 'parts'")
    lost = F.filter(F.reverse(F.split("losses", r"\+")), lambda x: x != "")  # an order that isn't canonical
    part = F.struct("target", F.lit("reviewer").alias("review"), "projection_id", lost.alias("losses"))
    listed = projections.groupBy("mapping_id").agg(F.sort_array(F.collect_list(part), asc=False).alias("projections"))
    rows = read(spark, sf_dir, "part").withColumn("mapping_id", F.concat(F.lit("p"), "p_partkey")).join(table(spark, sf_dir, "mappings").where("corpus = 'parts'").select("mapping_id", "value"), "mapping_id").join(listed, "mapping_id", "left")
    native = F.struct(F.col("value"), F.lit("part").alias("node_type"), F.lit("label").alias("feature"))
    none = F.from_json(F.lit("[]"), "array<struct<target:string,review:string,projection_id:string,losses:array<string>>>")
    document = F.struct(
        F.lit(True).alias("é"), F.col("p_size").alias("size"), F.array(F.lit("z"), F.lit("a")).alias("profiles"), F.coalesce("projections", none).alias("projections"), "mapping_id",
        F.lit("why").alias("rationale"), native.alias("native"), F.col("p_retailprice").alias("price"), F.struct("p_name").alias("review"),
    )
    found = rows.select("p_partkey", digests.document_digest(F.to_json(document, JSON), "mapping").alias("d"))
    return found.select("p_partkey", "d.digest", "d.problem")


HELD = "h AS (SELECT CAST(floor(c_custkey / 15) AS BIGINT) AS s, 'c' || c_custkey AS id, c_name FROM customer)"


@query(
    f"WITH {HELD}, p AS (SELECT s, string_agg('{{\"mapping_id\":\"' || id || '\"}}', ',' ORDER BY id) AS ids, string_agg('{{\"dependency_id\":\"d' || id || '\"}}', ',' ORDER BY id) AS needs FROM h GROUP BY s),"
    """ m AS (SELECT s, string_agg('{"component_id":"' || id || '","content_digest":"' || md5(c_name) || '","identity_algorithm":"sha256","kind":"k"}', ',' ORDER BY id) AS parts FROM h GROUP BY s)
    SELECT 'profile' AS kind, s AS id, 'sha256:' || sha256('{"dependencies":[' || needs || '],"mappings":[' || ids || '],"ontology_locks":[],"profile_id":"s' || s || '","semantic_domains":["x","y"]}') AS digest, CAST(NULL AS VARCHAR) AS problem FROM p
    UNION ALL SELECT 'manifest', s, CASE WHEN s % 9 <> 4 THEN 'sha256:' || sha256('{"components":[' || parts || ']}') END, CASE WHEN s % 9 = 4 THEN 'not_manifest' END FROM m
    UNION ALL SELECT 'evidence', c_custkey, CASE WHEN c_custkey % 5 > 1 THEN 'sha256:' || sha256('{"evidence_id":"e' || c_custkey || '","kind":"k","reviewed_content":{"name":"' || c_name || '"},"source_uri":"urn:' || c_custkey || '"}') END,
      CASE c_custkey % 5 WHEN 0 THEN 'not_evidence' WHEN 1 THEN 'not_json' END FROM customer"""
)
def document_digests(spark, sf_dir):
    """Digests of profiles, manifests and evidence records; documents that aren't what they should be have a problem instead."""
    customers = read(spark, sf_dir, "customer")
    held = customers.select(F.floor(F.col("c_custkey") / 15).alias("id"), F.concat(F.lit("c"), "c_custkey").alias("c"), "c_name")
    component = F.struct(F.lit("x").alias("license_ref"), F.col("c").alias("component_id"), F.lit("k").alias("kind"), F.lit("sha256").alias("identity_algorithm"), F.md5("c_name").alias("content_digest"))
    by = held.groupBy("id").agg(F.sort_array(F.collect_list("c"), asc=False).alias("c"), F.collect_list(component).alias("components"))
    profile = F.struct(
        F.concat(F.lit("s"), "id").alias("profile_id"), F.array(F.lit("y"), F.lit("x")).alias("semantic_domains"), F.transform("c", lambda x: F.struct(x.alias("mapping_id"))).alias("mappings"),
        F.transform("c", lambda x: F.struct(F.concat(F.lit("d"), x).alias("dependency_id"))).alias("dependencies"), F.array().cast("array<string>").alias("ontology_locks"),
    )
    twice = F.when(F.col("id") % 9 == 4, F.concat("components", F.slice("components", 1, 1))).otherwise(F.col("components"))
    record = F.struct(
        F.lit("k").alias("kind"), F.concat(F.lit("e"), "c_custkey").alias("evidence_id"), F.concat(F.lit("urn:"), "c_custkey").alias("source_uri"), F.struct(F.col("c_name").alias("name")).alias("reviewed_content"),
        F.when(F.col("c_custkey") % 5 != 0, "normalized-record").otherwise("link").alias("content_mode"), F.lit("seen").alias("note"),
    )
    text = F.to_json(record, JSON)
    text = F.when(F.col("c_custkey") % 5 == 1, F.concat(F.lit('{"kind":"k",'), F.substring(text, 2, 10_000))).otherwise(text)  # a key twice
    parts = [
        by.select(F.lit("profile").alias("kind"), "id", digests.document_digest(F.to_json(profile, JSON), "profile").alias("d")),
        by.select(F.lit("manifest").alias("kind"), "id", digests.document_digest(F.to_json(F.struct(twice.alias("components")), JSON), "manifest").alias("d")),
        customers.select(F.lit("evidence").alias("kind"), F.col("c_custkey").alias("id"), digests.document_digest(text, "evidence").alias("d")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "id", "d.digest", "d.problem")


TREE = """, leaves AS (SELECT plan, part, 'sha256:' || sha256(leaf) AS digest, row_number() OVER (PARTITION BY plan, part ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY plan, part) AS n FROM texts),
    l1 AS (SELECT plan, part, n, pos // 64 AS pos, 'sha256:' || sha256(string_agg(digest, ',' ORDER BY pos)) AS digest FROM leaves GROUP BY plan, part, n, pos // 64),
    l2 AS (SELECT plan, part, n, pos // 64 AS pos, 'sha256:' || sha256(string_agg(digest, ',' ORDER BY pos)) AS digest FROM l1 GROUP BY plan, part, n, pos // 64),
    l3 AS (SELECT plan, part, n, pos // 64 AS pos, 'sha256:' || sha256(string_agg(digest, ',' ORDER BY pos)) AS digest FROM l2 GROUP BY plan, part, n, pos // 64),
    roots AS (SELECT plan, part, digest FROM l1 WHERE n <= 64 UNION ALL SELECT plan, part, digest FROM l2 WHERE n > 64 AND n <= 4096 UNION ALL SELECT plan, part, digest FROM l3 WHERE n > 4096)"""


@query(
    """WITH o AS (SELECT c_nationkey AS plan, o_orderkey, o_custkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey),
    texts AS (SELECT n_nationkey AS plan, 'start' AS part, '{"node":' || n_nationkey || ',"ord":0}' AS leaf, 0 AS k FROM nation
      UNION ALL SELECT plan, 'final', '{"node":' || o_orderkey || ',"ord":' || o_orderkey || '}', o_orderkey FROM o
      UNION ALL SELECT c_nationkey, '0', '{"dst":' || c_nationkey || ',"ord":' || c_custkey || ',"src":' || c_custkey || ',"value":null,"value_present":false}', c_custkey FROM customer
      UNION ALL SELECT plan, '1', '{"dst":' || o_custkey || ',"ord":' || o_orderkey || ',"src":' || o_orderkey || ',"value":"' || o_orderstatus || '","value_present":true}', o_orderkey FROM o)"""
    + TREE
    + """ SELECT n_nationkey AS plan, 'sha256:' || sha256('{"algorithm":"walk-evidence/1","binding":"binding:' || n_regionkey || '","final":' || coalesce('"' || f.digest || '"', 'null') || ',"layers":"' || coalesce(l.layers, '') || '","plan":"plan:' || n_name || '","start":"' || s.digest || '"}') AS digest
    FROM nation JOIN roots s ON s.plan = n_nationkey AND s.part = 'start' LEFT JOIN roots f ON f.plan = n_nationkey AND f.part = 'final'
      LEFT JOIN (SELECT plan, string_agg(part || ':' || digest, ',' ORDER BY part) AS layers FROM roots WHERE part IN ('0', '1') GROUP BY plan) l ON l.plan = n_nationkey"""
)
def walk_digests(spark, sf_dir):
    """Digests of the evidence of walks from nations to their customers' orders, by trees of digests over ordered rows."""
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    orders = read(spark, sf_dir, "orders").join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("plan")), "o_custkey")
    key = lambda c: F.col(c).cast("long")
    plans = nation.select(F.col("n_nationkey").alias("plan"), F.concat(F.lit("plan:"), "n_name").alias("fingerprint"), F.concat(F.lit("binding:"), "n_regionkey").alias("binding"))
    starts = nation.select(F.col("n_nationkey").alias("plan"), F.lit(0).alias("ord"), key("n_nationkey").alias("node"))
    none = F.lit(None).cast("string")
    first = customer.select(F.col("c_nationkey").alias("plan"), F.lit(0).alias("step"), key("c_custkey").alias("ord"), key("c_custkey").alias("src"), key("c_nationkey").alias("dst"), F.lit(False).alias("value_present"), none.alias("value"))
    second = orders.select("plan", F.lit(1).alias("step"), key("o_orderkey").alias("ord"), key("o_orderkey").alias("src"), key("o_custkey").alias("dst"), F.lit(True).alias("value_present"), F.col("o_orderstatus").alias("value"))
    finals = orders.select("plan", key("o_orderkey").alias("ord"), key("o_orderkey").alias("node"))
    return digests.walk_digest(plans, starts, first.unionByName(second), finals, fanout=64)


@query(
    """SELECT 'commerce' AS corpus, 'p' || p_partkey AS dependency_id, CASE p_partkey % 7
      WHEN 0 THEN CASE WHEN p_size % 3 = 1 THEN 'fail' ELSE 'pass' END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'pass' ELSE 'fail' END
      WHEN 2 THEN CASE WHEN p_size % 4 <> 3 AND 'Brand#' || p_size IN (SELECT p_brand FROM part) THEN 'pass' ELSE 'fail' END WHEN 3 THEN CASE WHEN p_size % 4 = 0 THEN 'fail' ELSE 'pass' END
      WHEN 4 THEN CASE WHEN p_size % 2 = 0 OR 'MACHINERY' NOT IN (SELECT c_mktsegment FROM customer) THEN 'pass' ELSE 'fail' END WHEN 5 THEN CASE WHEN p_size % 2 = 0 AND p_size % 5 <> 0 THEN 'pass' ELSE 'fail' END
      ELSE CASE WHEN p_size % 2 = 0 OR 'N' NOT IN (SELECT min(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_partkey) THEN 'pass' ELSE 'fail' END END AS result FROM part"""
)
def dependency_results(spark, sf_dir):
    """Many dependencies of the commerce graph, of all kinds, evaluated together."""
    size, text = F.col("p_size"), F.lit
    pick = lambda *by_kind: F.element_at(F.array(*(x if isinstance(x, F.Column) else F.lit(x).cast("string") for x in by_kind)), (F.col("p_partkey") % 7 + 1).cast("int"))
    listed = lambda *values: F.array(*(F.lit(v) if isinstance(v, str) else v for v in values))
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    none = F.array().cast("array<string>")
    values = F.element_at(
        F.array(
            none, none, listed(F.concat(text("Brand#"), size)), F.when(size % 4 == 0, listed(F.col("p_type"), "X")).otherwise(listed(F.col("p_type"))),
            F.when(size % 2 == 0, listed(*segments)).otherwise(listed(*segments[:-1])), none, F.when(size % 2 == 0, listed("A", "N", "R")).otherwise(listed("A", "R")),
        ),
        (F.col("p_partkey") % 7 + 1).cast("int"),
    )
    needs = read(spark, sf_dir, "part").select(
        text("commerce").alias("corpus"),
        F.concat(text("p"), "p_partkey").alias("dependency_id"),
        pick("node-type-present", "feature-present", "native-value-present", "value-domain", "value-domain", "edge-present", "edge-value-domain").alias("kind"),
        pick(F.when(size % 3 == 0, "part").when(size % 3 == 1, "warehouse").otherwise("customer"), "part", "part", "part", "customer", None, "order").alias("node_type"),
        pick(None, F.when(size % 2 == 0, "p_brand").otherwise("p_colour"), "p_brand", "p_type", "c_mktsegment", None, None).alias("feature"),
        pick(None, None, None, None, None, F.when(size % 2 == 0, "order_customer").otherwise("order_parts"), "order_part_flag").alias("edge"),
        F.when(size % 5 == 0, "both").otherwise("outgoing").alias("direction"),
        F.when((F.col("p_partkey") % 7 == 2) & (size % 4 == 3), "int").otherwise("str").alias("value_type"),
        values.alias("values"),
        (F.col("p_partkey") % 7 == 4).alias("closed"),
        text("part").alias("target_type"),
        none.alias("steps"),
    )
    return prerequisites.evaluate_all(spark, {"commerce": commerce(spark, sf_dir)}, needs)
