"""The registered queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossgraph.derived import catalog, catalog_sql
from glossgraph.functions import digests
from glossgraph.operators import accounting, census, correspondence, ordering, paths, selectors, sets
from glossgraph.plans import prerequisites, references, resolver
from glossgraph.registry import query, read
from glossgraph.sources import catalog as catalogs
from glossgraph.sources.graph import CORPORA, SPAN, activity, all_corpora, commerce, library
from glossgraph.streaming import tables as streams

def node(type_number: int, key: str) -> str:
    """SQL of a node id."""
    return f"CAST({type_number * SPAN + 1} + {key} AS BIGINT)"


REGION, NATION, SUPPLIER, CUSTOMER, PART, ORDER = (lambda key, k=k: node(k, key) for k in range(6))
DOCUMENT = REGION
M = catalog_sql()
POSITIVE = "('exact', 'close', 'broader', 'narrower', 'related')"
UNMATCHED = "('ambiguous', 'native-only', 'unsupported')"
FIELDS = "corpus, corpus_version, kind, relation, target, node, feature, value"


def _fields(df: DataFrame) -> DataFrame:
    return df.select(*FIELDS.split(", "))


# Selectors


@query(f"SELECT {CUSTOMER('c_custkey')} AS node FROM customer")
def node_membership(spark, sf_dir):
    return selectors.membership(commerce(spark, sf_dir).nodes("customer"))


@query(f"SELECT {ORDER('o_orderkey')} AS node FROM orders WHERE o_orderstatus = 'F'")
def value_predicate(spark, sf_dir):
    return selectors.value_predicate(commerce(spark, sf_dir).nodes("order"), "o_orderstatus", "F")


@query(f"SELECT DISTINCT {ORDER('o_orderkey')} AS node FROM orders WHERE o_orderstatus IN ('F', 'O')")
def value_set_predicate(spark, sf_dir):
    return selectors.value_set_predicate(commerce(spark, sf_dir).nodes("order"), "o_orderstatus", ["F", "O"])


@query(f"SELECT {DOCUMENT('doc_id')} AS node FROM documents WHERE text IS NOT NULL AND text <> ''")
def presence_guard(spark, sf_dir):
    return selectors.guarded_membership(library(spark, sf_dir).nodes("document"), "text")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def invalid_keys(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    keyed = line.withColumn("key", F.col("l_orderkey") * 1000 + F.col("l_linenumber") + 1)
    return selectors.invalid_nodes(keyed, "key").select(
        F.floor((F.col("key") - 1) / 1000).alias("l_orderkey"), ((F.col("key") - 1) % 1000).cast("int").alias("l_linenumber"), "n"
    )


# Catalog


@query(M + f" SELECT {FIELDS} FROM m WHERE target = 'urn:status:F' AND kind IN ('node', 'value') AND relation IN {POSITIVE}")
def reverse_target_lookup(spark, sf_dir):
    return _fields(correspondence.find_by_target(catalog(spark, sf_dir), "urn:status:F", include_approximate=True))


@query(M + f" SELECT {FIELDS} FROM m WHERE corpus = 'commerce' AND kind = 'value' AND node = 'order' AND feature = 'o_orderpriority' AND value = '1-URGENT' AND (corpus_version IS NULL OR corpus_version = '1.10')")
def native_lookup_versioned(spark, sf_dir):
    found = correspondence.map_native(catalog(spark, sf_dir), "commerce", "1.10", kind="value", node="order", feature="o_orderpriority", value="1-URGENT")
    return _fields(found)


PAIRS = (
    " SELECT a.kind, a.target, a.corpus AS a_corpus, a.relation AS a_relation, a.node AS a_node, a.feature AS a_feature, a.value AS a_value,"
    " b.corpus AS b_corpus, b.relation AS b_relation, b.node AS b_node, b.feature AS b_feature, b.value AS b_value,"
    " CASE WHEN a.relation = 'exact' AND b.relation = 'exact' THEN 'exact' ELSE 'approximate-via-target' END AS relation, 'category' AS scope"
    " FROM m a JOIN m b ON a.kind = b.kind AND a.target = b.target AND a.corpus <> b.corpus"
)
PAIR_COLUMNS = ("kind", "target", *(f"{s}_{c}" for s in "ab" for c in ("corpus", "relation", "node", "feature", "value")), "relation", "scope")


@query(M + PAIRS + f" WHERE a.relation IN {POSITIVE} AND b.relation IN {POSITIVE} AND a.corpus = 'library' AND b.corpus = 'web'")
def correspondence_pairs(spark, sf_dir):
    return correspondence.correspondences(catalog(spark, sf_dir), "library", "web", include_approximate=True).select(*PAIR_COLUMNS)


#: All pairs of a target without a join: its few selectors are listed, and the list is taken apart twice.
PAIR_FIELDS = ("corpus", "relation", "node", "feature", "value")
LISTED = (
    f", g AS (SELECT kind, target, list({{{', '.join(f"'{c}': {c}" for c in PAIR_FIELDS)}}}) AS l FROM m WHERE relation IN {POSITIVE} AND target IS NOT NULL GROUP BY kind, target),"
    " x AS (SELECT kind, target, l, unnest(l) AS a FROM g), y AS (SELECT kind, target, a, unnest(l) AS b FROM x)"
    f" SELECT kind, target, {', '.join(f'{s}.{c} AS {s}_{c}' for s in 'ab' for c in PAIR_FIELDS)},"
    " CASE WHEN a.relation = 'exact' AND b.relation = 'exact' THEN 'exact' ELSE 'approximate-via-target' END AS relation, 'category' AS scope FROM y WHERE a.corpus <> b.corpus"
)


@query(M + LISTED)
def correspondence_all_corpora(spark, sf_dir):
    return correspondence.correspondences(catalog(spark, sf_dir), include_approximate=True).select(*PAIR_COLUMNS)


@query(
    M
    + f""" SELECT DISTINCT 'commerce' AS corpus, m.target, {ORDER('o_orderkey')} AS node FROM m JOIN orders ON m.value = o_orderstatus
    WHERE m.corpus = 'commerce' AND m.relation = 'exact' AND m.feature = 'o_orderstatus'
    UNION ALL SELECT DISTINCT 'commerce', m.target, {ORDER('o_orderkey')} FROM m JOIN orders ON m.value = o_orderpriority
    WHERE m.corpus = 'commerce' AND m.relation = 'exact' AND m.feature = 'o_orderpriority'
    UNION ALL SELECT DISTINCT 'commerce', m.target, {CUSTOMER('c_custkey')} FROM m JOIN customer ON m.value = c_mktsegment
    WHERE m.corpus = 'commerce' AND m.relation = 'exact' AND m.feature = 'c_mktsegment'"""
)
def catalog_nodes(spark, sf_dir):
    return correspondence.resolve_nodes(commerce(spark, sf_dir), catalog(spark, sf_dir), "1.10")


@query(
    M
    + f""" , origin AS (SELECT target FROM m WHERE corpus = 'logistics' AND node = 'line' AND feature = 'l_linestatus' AND value = 'F' AND relation = 'exact')
    SELECT 'commerce' AS corpus, m.node AS node_type, m.feature, m.value, m.target, {ORDER('o_orderkey')} AS node
    FROM m JOIN origin USING (target) JOIN orders ON o_orderstatus = m.value WHERE m.corpus = 'commerce' AND m.relation = 'exact' AND m.kind = 'value'"""
)
def correspondence_nodes(spark, sf_dir):
    """From one native category to the nodes of the corpora that share it."""
    rows = catalog(spark, sf_dir)  # literals of corpus and feature prune all tables that a lookup doesn't need
    origin = correspondence.map_native(rows, "logistics", kind="value", node="line", feature="l_linestatus", value="F")
    targets = [r.target for r in origin.select("target").distinct().collect()]  # of one selector: a few
    pairs = correspondence.correspondences(rows.where(F.col("target").isin(targets)), "logistics")
    wanted = pairs.where("a_feature = 'l_linestatus'").select("b_corpus", "b_node", "b_feature", "b_value", "target").distinct()
    # selectors of one category: metadata, as many rows as catalogs have selectors for it
    found = wanted.collect()
    corpora = {name: load(spark, sf_dir) for name, load in CORPORA.items() if name in {r.b_corpus for r in found}}  # no other is opened
    found = [r for r in found if r.b_corpus in corpora and r.b_node in corpora[r.b_corpus].tables]
    parts = []
    for corpus, node_type, feature in sorted({(r.b_corpus, r.b_node, r.b_feature) for r in found}):
        chosen = [(r.b_value, r.target) for r in found if (r.b_corpus, r.b_node, r.b_feature) == (corpus, node_type, feature)]
        rows_of = spark.createDataFrame(chosen, "value string, target string")
        nodes = corpora[corpus].nodes(node_type).select("node", F.col(feature).cast("string").alias("value"))
        nodes = nodes.where(F.col("value").isin([v for v, _ in chosen])).join(F.broadcast(rows_of), "value")
        parts.append(nodes.select(F.lit(corpus).alias("corpus"), F.lit(node_type).alias("node_type"), F.lit(feature).alias("feature"), "value", "target", "node"))
    return functools.reduce(DataFrame.unionByName, parts)


@query(
    M
    + f""" SELECT DISTINCT a.corpus, a.node, a.feature, a.value, a.relation AS a, b.relation AS b FROM m a JOIN m b
    ON a.corpus = b.corpus AND a.kind = b.kind AND a.node = b.node AND a.feature = b.feature AND a.value = b.value
    AND (a.corpus_version IS NULL OR b.corpus_version IS NULL OR a.corpus_version = b.corpus_version) AND (a.relation < b.relation OR (a.relation = b.relation AND coalesce(a.corpus_version, '') < coalesce(b.corpus_version, '')))
    WHERE (a.relation IN {UNMATCHED} OR b.relation IN {UNMATCHED}) AND NOT (a.relation = 'ambiguous' AND b.relation = 'ambiguous')"""
)
def disposition_conflicts(spark, sf_dir):
    found = catalogs.conflicts(catalog(spark, sf_dir))
    part = F.from_json("selector", "node string, feature string, value string")
    return found.select("corpus", part["node"].alias("node"), part["feature"].alias("feature"), part["value"].alias("value"), "a", "b")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 10 = 1 THEN 'kind' WHEN p_size % 10 = 2 THEN 'relation' WHEN p_size % 10 = 3 THEN 'selector' WHEN p_size % 10 = 4 THEN 'target_missing' WHEN p_size % 10 = 5 THEN 'target_forbidden' END AS problem
    FROM part WHERE p_size % 10 BETWEEN 1 AND 5"""
)
def catalog_violations(spark, sf_dir):
    """Rows of a catalog that Spark derives from parts, some of them wrong in one way each."""
    size, none = F.col("p_size") % 10, F.lit(None).cast("string")
    row = {
        "corpus": F.lit("parts"), "kind": F.when(size == 1, "word").otherwise("value"), "relation": F.when(size == 2, "same").when(size == 5, "native-only").otherwise("exact"),
        "target": F.when(size == 4, "no scheme").otherwise(F.concat(F.lit("urn:brand:"), F.col("p_brand").substr(7, 9))), "node": F.lit("part"), "feature": F.when(size != 3, F.lit("p_brand")), "value": F.col("p_brand"),
    }
    rows = read(spark, sf_dir, "part").select("p_partkey", *(row.get(c, none).cast("string").alias(c) for c in catalogs.MAPPING))
    return catalogs.row_violations(rows).select("p_partkey", "problem")


@query(
    M
    + """ SELECT corpus, corpus_version FROM (SELECT corpus, corpus_version, row_number() OVER (PARTITION BY corpus
    ORDER BY [CAST(x AS INT) FOR x IN string_split(corpus_version, '.')] DESC) AS r
    FROM (SELECT DISTINCT corpus, corpus_version FROM m WHERE corpus_version IS NOT NULL)) WHERE r = 1"""
)
def current_release(spark, sf_dir):
    versions = catalog(spark, sf_dir).where("corpus_version IS NOT NULL").select("corpus", "corpus_version").distinct()
    return catalogs.latest(versions, "corpus_version", ["corpus"])


# Conjunctions and paths


@query(f"SELECT {ORDER('o_orderkey')} AS node FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT {ORDER('o_orderkey')} FROM orders WHERE o_orderpriority = '1-URGENT'")
def exact_conjunction(spark, sf_dir):
    orders = commerce(spark, sf_dir).nodes("order")
    return selectors.all_values(orders, {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT"]})


@query(
    f"SELECT {ORDER('o_orderkey')} AS node FROM orders WHERE o_orderstatus IN ('F', 'O') INTERSECT SELECT {ORDER('o_orderkey')} FROM orders WHERE o_orderpriority = '2-HIGH'"
    f" INTERSECT SELECT {ORDER('o_orderkey')} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5"
)
def conjunction_three(spark, sf_dir):
    c = commerce(spark, sf_dir)
    orders = c.nodes("order")
    near = c.nodes("nation").where("n_nationkey < 5")
    back = paths.traverse(c, near, [paths.Step("customer_nation", "customer", "incoming"), paths.Step("order_customer", "order", "incoming")])
    domain = ("orders", "order")
    return sets.conjunction([(domain, selectors.all_values(orders, {"o_orderstatus": ["F", "O"], "o_orderpriority": ["2-HIGH"]})), (domain, back)])


@query(f"SELECT DISTINCT {NATION('c_nationkey')} AS node FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def edge_path_out(spark, sf_dir):
    c = commerce(spark, sf_dir)
    start = selectors.value_predicate(c.nodes("order"), "o_orderstatus", "P")
    return paths.traverse(c, start, [paths.Step("order_customer", "customer"), paths.Step("customer_nation", "nation")])


@query(f"SELECT DISTINCT {ORDER('o_orderkey')} AS node FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def edge_path_in(spark, sf_dir):
    c = commerce(spark, sf_dir)
    start = selectors.value_predicate(c.nodes("customer"), "c_mktsegment", "BUILDING")
    return paths.traverse(c, start, [paths.Step("order_customer", "order", "incoming")])


@query(f"SELECT DISTINCT {CUSTOMER('o_custkey')} AS node FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size = 1")
def edge_path_mixed(spark, sf_dir):
    c = commerce(spark, sf_dir)
    start = selectors.value_predicate(c.nodes("part"), "p_size", 1)
    return paths.traverse(c, start, [paths.Step("order_part_flag", "order", "incoming"), paths.Step("order_customer", "customer")])


FLAGS = "(SELECT l_orderkey, l_partkey, min(l_returnflag) AS flag, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT DISTINCT {PART('l_partkey')} AS node FROM {FLAGS} JOIN orders ON l_orderkey = o_orderkey WHERE flag IN ('A', 'R') AND o_orderstatus = 'P'")
def valued_edge_match(spark, sf_dir):
    c = commerce(spark, sf_dir)
    start = selectors.value_predicate(c.nodes("order"), "o_orderstatus", "P")
    return paths.traverse(c, start, [paths.Step("order_part_flag", "part", match_values=("A", "R"))])


@query(
    f"""SELECT 0 AS step, {ORDER('l_orderkey')} AS src, {PART('l_partkey')} AS dst, true AS value_present, CAST(line AS VARCHAR) AS value
    FROM {FLAGS} JOIN orders ON l_orderkey = o_orderkey WHERE line IN (1, 2) AND o_orderpriority = '5-LOW'"""
)
def valued_edge_evidence(spark, sf_dir):
    c = commerce(spark, sf_dir)
    start = selectors.value_predicate(c.nodes("order"), "o_orderpriority", "5-LOW")
    return paths.evidence(c, start, [paths.Step("order_part_line", "part", match_values=(1, 2))])


@query(
    f"""WITH e AS (SELECT {CUSTOMER('c_custkey')} AS c, {NATION('c_nationkey')} AS n, {REGION('n_regionkey')} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'),
    one AS (SELECT n, r, min(c) AS c FROM e GROUP BY 1, 2), two AS (SELECT r, min([c, n]) AS first FROM one GROUP BY 1)
    SELECT r AS node, array_to_string(list_append(first, r), '.') AS ord FROM two"""
)
def first_discovery(spark, sf_dir):
    c = commerce(spark, sf_dir)
    start = selectors.value_predicate(c.nodes("customer"), "c_mktsegment", "MACHINERY")
    found = paths.discovery_order(c, start, [paths.Step("customer_nation", "nation"), paths.Step("nation_region", "region")])
    return found.select("node", F.array_join("ord", ".").alias("ord"))


@query(f"""SELECT 0 AS step, {ORDER('o_orderkey')} AS src, {CUSTOMER('o_custkey')} AS dst FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 1, {ORDER('l_orderkey')}, {PART('l_partkey')} FROM {FLAGS} JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND flag = 'R'""")
def incoming_evidence(spark, sf_dir):
    """Edges of a walk against and along their direction, as they are stored."""
    c = commerce(spark, sf_dir)
    start = selectors.value_predicate(c.nodes("customer"), "c_mktsegment", "BUILDING")
    return paths.evidence(c, start, [paths.Step("order_customer", "order", "incoming"), paths.Step("order_part_flag", "part", match_values=("R",))]).select("step", "src", "dst")


@query("SELECT CAST(0 AS BIGINT) AS dangling, count(*) AS edges FROM orders")
def dangling_edges(spark, sf_dir):
    """Edges whose ends aren't there: hops rely on the ranges of ids, and this query on the nodes themselves."""
    c = commerce(spark, sf_dir)
    return paths.dangling(c, "order_customer")


@query(f"SELECT flag AS value, count(*) AS n FROM {FLAGS} JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY flag")
def edge_value_domain(spark, sf_dir):
    return paths.value_domain(commerce(spark, sf_dir), "order_part_flag", "order", "part")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_edges(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return paths.duplicate_pairs(line).withColumnsRenamed({"src": "l_orderkey", "dst": "l_suppkey"})


# Domains, prerequisites, resolution


@query(
    """WITH o AS (SELECT DISTINCT l_linestatus AS value FROM lineitem), r AS (SELECT DISTINCT o_orderstatus AS value FROM orders)
    SELECT NOT EXISTS (FROM o WHERE value NOT IN (SELECT value FROM r)) AS closed, NOT EXISTS (FROM r WHERE value NOT IN (SELECT value FROM o)) AS covered"""
)
def domain_closed(spark, sf_dir):
    observed = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("value"))
    return census.domain_state(observed, read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("value")))


@query("SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN (SELECT l_linestatus FROM lineitem)")
def domain_observed(spark, sf_dir):
    reviewed = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("value")).distinct()
    return sets.subset_violations(reviewed, read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("value")), ["value"])


@query(
    """WITH d AS (
      SELECT 'order' AS node_type, 'o_orderstatus' AS feature, CASE WHEN count(*) = 0 THEN 'fail' WHEN count(o_orderstatus) = 0 THEN 'unknown' ELSE 'pass' END AS result FROM orders
      UNION ALL SELECT 'customer', 'c_mktsegment', CASE WHEN count(*) = 0 THEN 'fail' WHEN count(c_mktsegment) = 0 THEN 'unknown' ELSE 'pass' END FROM customer
      UNION ALL SELECT 'part', 'p_colour', 'fail'
      UNION ALL SELECT 'customer', 'c_name', CASE WHEN count(*) = 0 THEN 'fail' WHEN count(c_name) = 0 THEN 'unknown' ELSE 'pass' END FROM customer)
    SELECT node_type, feature, result, CASE WHEN bool_or(result = 'fail') OVER (PARTITION BY node_type) THEN 'incompatible'
      WHEN bool_or(result = 'unknown') OVER (PARTITION BY node_type) THEN 'unverified' ELSE 'verified-compatible' END AS state FROM d"""
)
def prerequisite_state(spark, sf_dir):
    c = commerce(spark, sf_dir)
    needs = [("order", "o_orderstatus"), ("customer", "c_mktsegment"), ("part", "p_colour"), ("customer", "c_name")]
    return prerequisites.state(prerequisites.feature_results(c, needs), ["node_type"])


@query(
    M
    + """ , p AS (SELECT target, corpus, CASE relation WHEN 'broader' THEN 'undercoverage' WHEN 'narrower' THEN 'overcoverage' WHEN 'close' THEN 'overcoverage+undercoverage' END AS losses
      FROM m WHERE relation IN ('exact', 'close', 'broader', 'narrower'))
    SELECT target, CASE count(DISTINCT losses) WHEN 0 THEN 'exactly-comparable' WHEN 1 THEN 'approximately-comparable' ELSE 'heterogeneous-loss' END AS state FROM p GROUP BY target"""
)
def comparison_state(spark, sf_dir):
    plans = resolver.with_losses(catalog(spark, sf_dir)).where(F.col("relation").isin("exact", "close", "broader", "narrower"))
    return sets.comparison_state(plans, ["target"])


@query(
    M
    + """ SELECT corpus, target, CASE WHEN category IS NOT NULL THEN 'refused' WHEN e = 1 THEN 'exact' ELSE 'approximate' END AS status, category FROM (
      SELECT *, CASE WHEN e > 1 THEN 'multiple_exact_bindings' WHEN e = 1 THEN NULL WHEN s = 0 THEN 'approximation_not_authorized' WHEN s > 1 THEN 'multiple_approximate_bindings' WHEN b = 0 THEN 'approximation_loss_not_accepted' END AS category
      FROM (SELECT corpus, target, count(*) FILTER (WHERE relation = 'exact') AS e, count(*) FILTER (WHERE relation IN ('close', 'broader', 'narrower')) AS s, count(*) FILTER (WHERE relation = 'broader') AS b FROM m WHERE target IS NOT NULL GROUP BY 1, 2))"""
)
def approximate_choice(spark, sf_dir):
    return resolver.choose(resolver.with_losses(catalog(spark, sf_dir)), ["undercoverage"])


@query(
    M
    + """ SELECT corpus, node, feature, count(*) AS bindings, count(*) FILTER (WHERE relation = 'exact') AS exact, count(*) FILTER (WHERE relation = 'close') AS close,
    count(*) FILTER (WHERE relation = 'broader') AS broader, count(*) FILTER (WHERE relation = 'narrower') AS narrower, count(*) FILTER (WHERE relation = 'related') AS related,
    count(*) FILTER (WHERE relation = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE relation = 'native-only') AS native_only, count(*) FILTER (WHERE relation = 'unsupported') AS unsupported
    FROM m GROUP BY 1, 2, 3"""
)
def capability_facts(spark, sf_dir):
    return resolver.capability_facts(catalog(spark, sf_dir), ["corpus", "node", "feature"])


@query(
    M
    + f""" , g AS (SELECT target FROM m WHERE corpus = 'commerce' AND target LIKE 'urn:status:%' AND relation = 'exact' GROUP BY target HAVING count(*) = 1)
    SELECT g.target, {ORDER('o_orderkey')} AS node FROM g JOIN m USING (target) JOIN orders ON o_orderstatus = m.value WHERE m.corpus = 'commerce'"""
)
def execute_exact(spark, sf_dir):
    """All targets that one exact row expresses, and their nodes by one join of a feature with the rows."""
    rows = catalog(spark, sf_dir).where("corpus = 'commerce' AND target LIKE 'urn:status:%'")
    chosen = resolver.choose(resolver.with_losses(rows), []).where("status = 'exact'")
    return correspondence.resolve_nodes(commerce(spark, sf_dir), rows.join(chosen.select("corpus", "target"), ["corpus", "target"], "left_semi"), "1.10").select("target", "node")


# Census


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS corpus, '{t}' AS node_type, count(*) AS n FROM {table}"
        for c, t, table in (
            ("commerce", "region", "region"), ("commerce", "nation", "nation"), ("commerce", "supplier", "supplier"), ("commerce", "customer", "customer"), ("commerce", "part", "part"),
            ("commerce", "order", "orders"), ("activity", "event", "events"), ("activity", "user", "(SELECT DISTINCT user_id FROM events)"), ("library", "document", "documents"),
            ("library", "page", "pages"), ("library", "turn", "conversations"), ("library", "item", "benchmark"), ("library", "vector", "embeddings"),
        )
    )
)
def type_census(spark, sf_dir):
    return census.type_census(list(all_corpora(spark, sf_dir).values()))


@query(
    " UNION ALL ".join(
        f"SELECT 'commerce' AS corpus, 'order' AS node_type, '{f}' AS feature, count({f}) AS raw, count(*) FILTER (WHERE CAST({f} AS VARCHAR) <> '') AS populated,"
        f" count(*) FILTER (WHERE CAST({f} AS VARCHAR) = '') AS empty, count(DISTINCT {f}) FILTER (WHERE CAST({f} AS VARCHAR) <> '') AS distinct FROM orders"
        for f in ("o_orderstatus", "o_orderpriority", "o_custkey")
    )
)
def feature_census(spark, sf_dir):
    return census.feature_census(commerce(spark, sf_dir), "order", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    " UNION ALL ".join(
        f"SELECT 'commerce' AS corpus, '{e}' AS edge, '{s}' AS source_type, '{t}' AS target_type, {v} AS value_type, count(*) AS n, CAST({n} AS BIGINT) AS n_values FROM {table}"
        for e, s, t, v, n, table in (
            ("order_customer", "order", "customer", "NULL", "0", "orders"), ("customer_nation", "customer", "nation", "NULL", "0", "customer"), ("supplier_nation", "supplier", "nation", "NULL", "0", "supplier"),
            ("nation_region", "nation", "region", "NULL", "0", "nation"), ("order_part_flag", "order", "part", "'str'", "count(flag)", FLAGS), ("order_part_line", "order", "part", "'int'", "count(line)", FLAGS),
            ("order_supplier", "order", "supplier", "NULL", "0", "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"),
        )
    )
)
def edge_census(spark, sf_dir):
    return census.edge_census(commerce(spark, sf_dir))


@query("SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INT) AS rank FROM (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, value LIMIT 20")
def top_values(spark, sf_dir):
    return census.top_values(activity(spark, sf_dir).nodes("event"), "user_id", 20)


@query("SELECT o_orderpriority, count(*) AS n, (list(o_orderkey ORDER BY o_orderkey))[1] AS first_key, (list(o_orderkey ORDER BY o_orderkey))[3] AS third_key FROM orders GROUP BY 1")
def sampled_counts(spark, sf_dir):
    found = census.sampled_counts(commerce(spark, sf_dir).nodes("order"), "o_orderpriority", 3, "o_orderkey")
    return found.select("o_orderpriority", "n", F.get("first", F.lit(0)).alias("first_key"), F.get("first", F.lit(2)).alias("third_key"))


@query("SELECT sha256(text) AS form_hash, doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def written_form_index(spark, sf_dir):
    return census.form_index(read(spark, sf_dir, "documents"), "text", "doc_id").select("form_hash", "doc_id", "n")


@query("SELECT doc_id FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = 3)")
def written_form_lookup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return census.find_form(docs, "text", docs.where("doc_id = 3").select("text")).select("doc_id")


@query(
    f"""SELECT {ORDER('o_orderkey')} AS word, {NATION('c_nationkey')} AS lexeme, ends_with(c_name, lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AND n_name = 'NATION_' || c_nationkey AS agrees FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
)
def word_lexeme_link(spark, sf_dir):
    """Each order's nation over two containments, with exactly one of each, and whether their forms agree."""
    c = commerce(spark, sf_dir)
    up = c.edges("order_customer").join(c.edges("customer_nation").select(F.col("dst").alias("lexeme"), F.col("src").alias("dst")), "dst").select(F.col("src").alias("word"), F.col("dst").alias("holder"), "lexeme")
    once = up.groupBy("word").agg(F.min("lexeme").alias("lexeme"), F.min("holder").alias("holder"), F.count("*").alias("n")).where("n = 1")
    forms = c.nodes("customer").select(F.col("node").alias("holder"), "c_name", "c_custkey", "c_nationkey")
    names = c.nodes("nation").select(F.col("node").alias("lexeme"), "n_name")
    named = F.endswith("c_name", F.lpad(F.col("c_custkey").cast("string"), 9, "0")) & (F.col("n_name") == F.concat(F.lit("NATION_"), "c_nationkey"))
    return once.join(forms, "holder").join(names, "lexeme").select("word", "lexeme", named.alias("agrees"))


# Accounting


ITEMS = "(SELECT DISTINCT 'documents' AS corpus, 'value:source=' || CAST(to_json(source) AS VARCHAR) AS item_id FROM documents UNION ALL SELECT DISTINCT 'orders', 'value:o_orderstatus=' || CAST(to_json(o_orderstatus) AS VARCHAR) FROM orders UNION ALL SELECT DISTINCT 'documents', 'value:lang=' || CAST(to_json(lang) AS VARCHAR) FROM documents)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, orders = read(spark, sf_dir, "documents"), read(spark, sf_dir, "orders")
    one = lambda df, corpus, f: df.select(F.lit(corpus).alias("corpus"), accounting.item_id("value", F.lit(f), F.col(f)).alias("item_id")).distinct()
    return one(docs, "documents", "source").unionByName(one(orders, "orders", "o_orderstatus")).unionByName(one(docs, "documents", "lang"))


def _accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    return rows.select(accounting.item_id("value", F.col("feature"), F.col("value")).alias("item_id"), F.col("relation").alias("assessment"), "target", F.col("source").alias("source_id"))


ACCOUNTED = "a AS (SELECT 'value:' || feature || '=' || CAST(to_json(value) AS VARCHAR) AS item_id, relation AS assessment, target, source AS source_id FROM m)"


@query(
    M
    + f""", {ACCOUNTED}, i AS (SELECT * FROM {ITEMS}), s AS (SELECT item_id, max(CASE WHEN target IS NOT NULL THEN 1 ELSE 0 END) AS shared FROM a GROUP BY 1)
    SELECT corpus, count(*) AS items, count(shared) AS reviewed, count(*) FILTER (WHERE shared = 1) AS common, count(*) FILTER (WHERE shared IS NULL) AS unreviewed FROM i LEFT JOIN s USING (item_id) GROUP BY corpus"""
)
def coverage_report(spark, sf_dir):
    return accounting.coverage_report(_items(spark, sf_dir), _accounted(spark, sf_dir), ["corpus"])


@query(
    M
    + f""", {ACCOUNTED} SELECT item_id, string_agg(DISTINCT assessment, '+' ORDER BY assessment) AS assessments, bool_or(target IS NOT NULL) AS has_target,
    string_agg(DISTINCT source_id, '+' ORDER BY source_id) AS sources FROM a GROUP BY item_id"""
)
def research_accounting(spark, sf_dir):
    return accounting.research_accounting(_accounted(spark, sf_dir))


@query(
    """SELECT lang, CAST(sum(n_chars) AS BIGINT) AS total, CAST(coalesce(sum(n_chars) FILTER (WHERE quality = 1), 0) AS BIGINT) AS covered,
    CAST(round_even(1000.0 * coalesce(sum(n_chars) FILTER (WHERE quality = 1), 0) / sum(n_chars), 0) AS BIGINT) AS per_mille FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""
)
def weighted_coverage(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return accounting.weighted_coverage(rows, "lang", "n_chars", F.col("quality") == 1)


ROUTED = "(SELECT c_mktsegment, coalesce(CASE WHEN n_regionkey = 0 THEN 'C' WHEN n_regionkey = 1 THEN 'D' WHEN n_regionkey = 2 THEN 'F' END, 'H') AS owner FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("n_regionkey") == 0, "C").when(F.col("n_regionkey") == 1, "D").when(F.col("n_regionkey") == 2, "F")
    routes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), owner.alias("owner")).where("owner IS NOT NULL")
    return accounting.route(read(spark, sf_dir, "customer"), routes, "c_nationkey")


@query("SELECT c_mktsegment, " + ", ".join(f"count(*) FILTER (WHERE owner = '{b}') AS {b}" for b in accounting.BUCKETS) + f" FROM {ROUTED} GROUP BY 1")
def queue_pivot(spark, sf_dir):
    return accounting.queue(_routed(spark, sf_dir), "c_mktsegment")


@query(f"SELECT c_mktsegment, owner, count(*) AS n FROM {ROUTED} GROUP BY ROLLUP (c_mktsegment, owner)")
def queue_rollup(spark, sf_dir):
    return accounting.queue_totals(_routed(spark, sf_dir), "c_mktsegment")


@query(M + f""", {ACCOUNTED} SELECT DISTINCT item_id FROM a WHERE item_id NOT IN (SELECT item_id FROM {ITEMS})""")
def denominator_gaps(spark, sf_dir):
    return accounting.gaps(_accounted(spark, sf_dir).select("item_id").distinct(), _items(spark, sf_dir))


@query("SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
def release_delta(spark, sf_dir):
    new = read(spark, sf_dir, "orders")
    old = new.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    columns = ["o_orderkey", "o_orderstatus"]
    return accounting.added(new.select(*columns), old.select(*columns))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, source) AS label FROM documents")
def overlay_merge(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    items = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("label"))
    return accounting.overlay(items, docs.select("doc_id", F.col("source").alias("label")), "doc_id", "label")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def override_patch(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    items = read(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return accounting.patched(items, labels.where("toxic = 1").select("doc_id"), labels.select("doc_id", "quality"), "doc_id", "quality")


@query(
    """SELECT coalesce(d.k, o.k) AS code, CASE WHEN o.k IS NULL THEN 'defined-only' WHEN d.k IS NULL THEN 'observed-only' ELSE 'both' END AS state
    FROM (SELECT DISTINCT c_custkey AS k FROM customer) d FULL JOIN (SELECT DISTINCT user_id * 7 AS k FROM events) o ON d.k = o.k"""
)
def reconcile_codes(spark, sf_dir):
    defined = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")).distinct()
    observed = read(spark, sf_dir, "events").select((F.col("user_id") * 7).alias("code")).distinct()
    return accounting.reconcile(defined, observed, "code")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def relational_division(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return accounting.holders_of_all(events, "user_id", events.select("event_type"), "event_type")


# Order


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type = 'purchase'")
def latest_event(spark, sf_dir):
    return ordering.latest(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").where("event_type = 'purchase'").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, CAST(r AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2")
def last_two_events(spark, sf_dir):
    return ordering.last_two(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "position")


@query("SELECT user_id, event_id, previous FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value <= previous")
def monotonic_violations(spark, sf_dir):
    return ordering.not_increasing(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "previous")


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations"""
)
def running_section(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return ordering.section(rows, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "section")


@query("SELECT p_name, p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_name) AS INT) AS rank FROM part")
def utf16_order(spark, sf_dir):
    window = Window.partitionBy("p_brand").orderBy(ordering.utf16(F.col("p_name")))
    return read(spark, sf_dir, "part").select("p_name", "p_partkey", F.rank().over(window).alias("rank"))


# Scalars


@query("SELECT page_id, 'value:url=' || CAST(to_json(url) AS VARCHAR) AS item, 'value' AS kind, 'url' AS feature, replace(replace(url, '~', '~0'), '/', '~1') AS pointer FROM pages")
def item_id_codec(spark, sf_dir):
    item = accounting.item_id("value", F.lit("url"), F.col("url"))
    kind, feature, _ = accounting.item_parts(F.col("item"))
    return read(spark, sf_dir, "pages").withColumn("item", item).select("page_id", "item", kind.alias("kind"), feature.alias("feature"), accounting.pointer_token(F.col("url")).alias("pointer"))


@query("SELECT doc_id, 'sha256:' || sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def content_digest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", digests.text_digest(F.col("text")).alias("digest"))


@query("""SELECT o_orderkey, 'sha256:' || sha256('{"custkey":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def row_digest(spark, sf_dir):
    fields = {"status": F.col("o_orderstatus"), "custkey": F.col("o_custkey"), "priority": F.col("o_orderpriority")}
    return read(spark, sf_dir, "orders").select("o_orderkey", digests.row_digest(fields).alias("digest"))


# References and closures


@query(
    """SELECT u.user_id, CASE WHEN c_custkey IS NULL THEN 'no_reference' ELSE 'resolved' END AS status, 'urn:customer:' || c_custkey AS entity
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN customer ON c_custkey = user_id"""
)
def identity_resolution(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("urn:customer:"), "c_custkey").alias("entity"))
    rows = users.join(customers, "user_id", "left").withColumn("strength", F.when(F.col("entity").isNotNull(), references.EXECUTABLE).otherwise("unknown"))
    return references.resolve_identities(rows, ["user_id"])


@query(
    """SELECT doc_id, 'urn:x:1.0:lex:' || (doc_id + 1) || ':form:' || substr(sha256(source), 1, 16) AS iri, '1.0' AS revision, doc_id + 1 AS node, substr(sha256(source), 1, 16) AS form FROM documents"""
)
def lexical_iris(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", references.lexical_iri("urn:x", "1.0", F.col("doc_id") + 1, F.col("source")).alias("iri"))
    revision, number, form = references.lexical_parts(F.col("iri"))
    return docs.select("doc_id", "iri", revision.alias("revision"), number.alias("node"), form.alias("form"))


@query("SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def evidence_closure(spark, sf_dir):
    """Bindings whose evidence isn't there."""
    bound = read(spark, sf_dir, "labels").where("quality = 0").select("doc_id", "quality").distinct()
    return sets.subset_violations(bound, read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), ["doc_id"])


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def overlapping_sets(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).select("user_id")
    return sets.disjointness_violations(of("purchase"), of("click"), ["user_id"])


@query(ITEMS.strip("()"))
def denominator_items(spark, sf_dir):
    return _items(spark, sf_dir)


@query(
    "SELECT role, "
    + ", ".join(f"count(*) FILTER (WHERE d = '{d}') AS {d}" for d in ("accept", "reject", "pending"))
    + " FROM (SELECT role, CASE WHEN length(text) > 400 THEN 'accept' WHEN length(text) > 200 THEN 'reject' ELSE 'pending' END AS d FROM conversations) GROUP BY role"
)
def disposition_counts(spark, sf_dir):
    size = F.length("text")
    turns = read(spark, sf_dir, "conversations").withColumn("owner", F.when(size > 400, "accept").when(size > 200, "reject").otherwise("pending"))
    return accounting.queue(turns, "role", ("accept", "reject", "pending"))


# Streams


@query("SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def stream_census(spark, sf_dir):
    return streams.event_census(spark, sf_dir)
