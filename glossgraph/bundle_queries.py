"""Registered queries over bundles: compilation, prerequisites, resolution, execution, rules and changes; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossgraph.bundles import table, with_tables
from glossgraph.functions import digests
from glossgraph.operators import accounting, changes, ordering, sets
from glossgraph.operators import violations as rules
from glossgraph.plans import bindings, executor
from glossgraph.registry import query, read
from glossgraph.sources.graph import commerce

KEY = ", ".join(bindings.SEMANTIC_KEY)
#: Bindings in SQL: reviewed projections of reviewed mappings.
BOUND = with_tables("mappings", "projections") + (
    ", b AS (SELECT p.*, m.node_type, m.feature, m.value, m.shape FROM projections p JOIN mappings m USING (corpus, mapping_id) WHERE p.reviewed AND m.reviewed),"
    " s AS (SELECT * FROM b WHERE reference_kind = 'semantic-pivot' AND query_role = 'semantic-constraint'),"
    " a AS (SELECT * FROM b WHERE reference_kind = 'authority-value' AND query_role = 'authority-value-filter')"
)


def resolution_sql(rows: str, key: str, name: str) -> str:
    """What keys resolve to if undercoverage alone is accepted, exact ones alone in `exact_category`."""
    return f""", {name} AS (SELECT *, CASE WHEN e > 1 THEN 'multiple_exact_bindings' WHEN e = 1 THEN NULL WHEN s = 0 AND r > 0 THEN 'non_substitutive_mapping'
        WHEN s = 0 OR f = 0 THEN 'approximation_not_authorized' WHEN f > 1 THEN 'multiple_approximate_bindings' WHEN fit_losses NOT IN ('', 'undercoverage') THEN 'approximation_loss_not_accepted' END AS category
      FROM (SELECT corpus, {key}, count(*) FILTER (WHERE assessment = 'exact') AS e, count(*) FILTER (WHERE assessment IN ('close', 'broader', 'narrower')) AS s,
        count(*) FILTER (WHERE assessment IN ('close', 'broader', 'narrower') AND eligible) AS f, count(*) FILTER (WHERE assessment = 'related') AS r,
        min(projection_id) FILTER (WHERE assessment = 'exact') AS exact_id, arg_min(projection_id, projection_id) FILTER (WHERE assessment IN ('close', 'broader', 'narrower') AND eligible) AS fit_id,
        arg_min(losses, projection_id) FILTER (WHERE assessment IN ('close', 'broader', 'narrower') AND eligible) AS fit_losses FROM {rows} GROUP BY corpus, {key})),
      {name}d AS (SELECT corpus, {key}, CASE WHEN category IS NOT NULL THEN 'refused' WHEN e = 1 THEN 'exact' ELSE 'approximate' END AS status, category,
        CASE WHEN category IS NULL THEN CASE WHEN e = 1 THEN exact_id ELSE fit_id END END AS projection_id, CASE WHEN category IS NULL AND e = 0 THEN fit_losses ELSE '' END AS losses FROM {name})"""


def _bound(spark, sf_dir):
    return bindings.compiled(table(spark, sf_dir, "mappings"), table(spark, sf_dir, "projections"))


def _resolved(spark, sf_dir, kind="semantic", key=bindings.SEMANTIC_KEY, accepted=("undercoverage",)):
    return bindings.resolve(bindings.index(_bound(spark, sf_dir), kind), key, accepted)


def _flat(df):
    return df.withColumn("losses", F.array_join("losses", "+"))


# Compilation


@query(
    with_tables("variants")
    + """ SELECT corpus, release, CASE WHEN n > 1 AND s > 1 THEN 'profile_release_conflict' ELSE 'duplicate_bundle_variant' END AS category FROM (
      SELECT corpus, release, count(*) AS n, count(DISTINCT fingerprint || parent_digest || coalesce(bundle_digest, '')) AS s FROM variants GROUP BY 1, 2) WHERE n > 1"""
)
def compile_problems(spark, sf_dir):
    return bindings.compile_problems(table(spark, sf_dir, "variants"))


SIZES = " UNION ALL ".join(
    f"SELECT '{kind}' AS index, count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS entries, max(n) AS most FROM (SELECT count(*) AS n FROM {rows} GROUP BY {', '.join(key)})"
    for kind, rows, key in (
        ("native", "(SELECT * FROM mappings WHERE reviewed)", ("corpus", *bindings.NATIVE_KEY)),
        ("semantic", "s", bindings.SEMANTIC_KEY),
        ("authority", "a", bindings.AUTHORITY_KEY),
        ("identity", "(SELECT * FROM external_refs WHERE reviewed AND reference_kind = 'entity-identity' AND authority_system IS NOT NULL)", bindings.IDENTITY_KEY),
        ("identifier", "(SELECT * FROM external_refs WHERE reviewed AND reference_kind = 'catalogue-identifier' AND issuer IS NOT NULL)", bindings.IDENTIFIER_KEY),
    )
)


@query(BOUND + ", " + with_tables("external_refs").removeprefix("WITH ") + f" SELECT * FROM ({SIZES})")
def binding_indexes(spark, sf_dir):
    """Keys and entries of the five indexes that bundles compile to."""
    mappings, refs, bound = table(spark, sf_dir, "mappings"), table(spark, sf_dir, "external_refs"), _bound(spark, sf_dir)
    parts = [
        bindings.index_sizes(mappings, "native", ("corpus", *bindings.NATIVE_KEY)),
        bindings.index_sizes(bound, "semantic", bindings.SEMANTIC_KEY),
        bindings.index_sizes(bound, "authority", bindings.AUTHORITY_KEY),
        bindings.index_sizes(refs, "identity", bindings.IDENTITY_KEY),
        bindings.index_sizes(refs, "identifier", bindings.IDENTIFIER_KEY),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(BOUND + ", " + with_tables("external_refs").removeprefix("WITH ") + f" SELECT *, 1 AS missing FROM ({SIZES})")
def index_lookups(spark, sf_dir):
    """The five indexes, built as bucketed tables and asked for all of their keys and one that they lack."""
    mappings, refs, bound = table(spark, sf_dir, "mappings"), table(spark, sf_dir, "external_refs"), _bound(spark, sf_dir)
    out = None
    for kind, rows, key in (
        ("native", mappings, ("corpus", *bindings.NATIVE_KEY)),
        ("semantic", bound, bindings.SEMANTIC_KEY),
        ("authority", bound, bindings.AUTHORITY_KEY),
        ("identity", refs, bindings.IDENTITY_KEY),
        ("identifier", refs, bindings.IDENTIFIER_KEY),
    ):
        rows = bindings.index(rows, kind).na.fill("", list(key))  # a join meets no nulls
        keys = rows.select(*key)
        absent = keys.limit(1).select(*(F.lit("absent").alias(k) for k in key))
        met = bindings.look_up(keys.unionByName(absent), bindings.build_index(rows, kind, key), key)
        sizes = met.groupBy(*key).agg(F.count("found").alias("n"))
        summed = sizes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("keys"), F.sum("n").alias("entries"), F.max("n").alias("most"), F.count(F.when(F.col("n") == 0, 1)).cast("int").alias("missing"))
        part = summed.select(F.lit(kind).alias("index"), "keys", "entries", "most", "missing")
        out = part if out is None else out.unionByName(part)
    return out


FACTS = BOUND + (
    ", n AS (SELECT corpus, profile, capability, count(*) FILTER (WHERE reviewed AND native_state <> 'unsupported') AS reviewed_native_support, count(*) FILTER (WHERE reviewed AND native_state = 'ambiguous') AS ambiguous,"
    " count(*) FILTER (WHERE reviewed AND native_state = 'native-only') AS native_only, count(*) FILTER (WHERE reviewed AND native_state = 'unsupported') AS unsupported, count(*) FILTER (WHERE reviewed) AS mappings,"
    " min(mapping_id) FILTER (WHERE reviewed) AS first_mapping, max(mapping_id) FILTER (WHERE reviewed) AS last_mapping FROM mappings WHERE starts_with(capability, profile || '.') GROUP BY 1, 2, 3),"
    " c AS (SELECT corpus, profile, capability, count(*) AS shared_projections, "
    + ", ".join(f"count(*) FILTER (WHERE assessment = '{x}') AS {x}" for x in bindings.ASSESSMENTS)
    + " FROM b GROUP BY 1, 2, 3), facts AS (SELECT n.*, coalesce(shared_projections, 0) AS shared_projections, "
    + ", ".join(f"coalesce({x}, 0) AS {x}" for x in bindings.ASSESSMENTS)
    + " FROM n LEFT JOIN c USING (corpus, profile, capability))"
)


@query(FACTS + " SELECT * FROM facts")
def binding_facts(spark, sf_dir):
    return bindings.facts(table(spark, sf_dir, "mappings"), table(spark, sf_dir, "projections"))


# Prerequisites

CHOSEN = with_tables("variants", "states") + (
    ", j AS (SELECT s.*, v.parent_digest, v.parent_compatibility, v.bundle_digest, coalesce(v.fingerprint = s.fingerprint, false) AS fresh FROM states s LEFT JOIN variants v USING (corpus, release)),"
    " c AS (SELECT v.corpus, CASE WHEN count(j.corpus) = 0 THEN 'missing_prerequisite' WHEN count(*) FILTER (WHERE fresh) = 0 THEN 'stale_prerequisite' WHEN count(*) FILTER (WHERE fresh) > 1 THEN 'ambiguous_prerequisite_variant' END AS category"
    " FROM (SELECT DISTINCT corpus FROM variants) v LEFT JOIN j USING (corpus) GROUP BY 1),"
    """ g AS (SELECT c.corpus, coalesce(c.category, CASE WHEN parent_state = 'odd' THEN 'invalid_prerequisite' WHEN parent_state = 'unverified' THEN 'parent_unverified' WHEN parent_state = 'incompatible' THEN 'parent_incompatible'
      WHEN parent_state = 'verified-exact' AND observed_parent_digest <> parent_digest THEN 'stale_prerequisite' WHEN parent_state = 'verified-compatible' AND observed_parent_digest = parent_digest THEN 'invalid_prerequisite'
      WHEN parent_state = 'verified-compatible' AND parent_compatibility <> 'dependency-verified' THEN 'parent_incompatible' WHEN NOT dependencies_complete THEN 'stale_prerequisite' WHEN NOT dependencies_pass THEN 'dependency_unavailable'
      WHEN bundle_digest IS NULL THEN CASE WHEN bundle_state <> 'not-required' OR active_bundle_digest IS NOT NULL THEN 'invalid_prerequisite' END
      WHEN bundle_state = 'unavailable' THEN 'ontology_bundle_unavailable' WHEN bundle_state <> 'verified' OR active_bundle_digest IS NULL THEN 'invalid_prerequisite' WHEN active_bundle_digest <> bundle_digest THEN 'stale_prerequisite' END) AS category
      FROM c LEFT JOIN (SELECT * FROM j WHERE fresh) j ON c.corpus = j.corpus AND c.category IS NULL)"""
)


@query(CHOSEN + " SELECT corpus, category FROM c")
def prerequisite_selection(spark, sf_dir):
    return bindings.selected_states(table(spark, sf_dir, "states"), table(spark, sf_dir, "variants")).select("corpus", "category")


@query(CHOSEN + " SELECT corpus, category FROM g")
def prerequisite_refusals(spark, sf_dir):
    return bindings.gates(table(spark, sf_dir, "states"), table(spark, sf_dir, "variants"))


def _gates(spark, sf_dir):
    """The first two corpora's gates as those of parts and suppliers."""
    found = bindings.gates(table(spark, sf_dir, "states"), table(spark, sf_dir, "variants"))
    name = F.when(F.col("corpus") == "corpus0", "parts").when(F.col("corpus") == "corpus1", "suppliers")
    return found.withColumn("corpus", name).where("corpus IS NOT NULL")


NAMED_GATES = ", gates AS (SELECT CASE corpus WHEN 'corpus0' THEN 'parts' ELSE 'suppliers' END AS corpus, category AS problem FROM g WHERE corpus IN ('corpus0', 'corpus1'))"


@query(
    FACTS + ", " + CHOSEN.removeprefix("WITH ").replace(", c AS (", ", chosen AS (").replace("FROM c LEFT", "FROM chosen c LEFT") + NAMED_GATES
    + """ SELECT f.*, CASE WHEN reviewed_native_support = 0 THEN 'absent' WHEN problem IS NULL THEN 'active' ELSE 'unavailable' END AS state,
      reviewed_native_support > 0 AND problem IS NULL AND exact > 0 AS executable_exact FROM facts f LEFT JOIN gates USING (corpus)"""
)
def capability_states(spark, sf_dir):
    return bindings.capabilities(bindings.facts(table(spark, sf_dir, "mappings"), table(spark, sf_dir, "projections")), _gates(spark, sf_dir))


# Resolution


@query(
    BOUND
    + f""" SELECT corpus, {KEY}, CASE WHEN e = 1 THEN 'exact' ELSE 'refused' END AS status, CASE WHEN e > 1 THEN 'multiple_exact_bindings' WHEN e = 0 THEN 'no_exact_binding' END AS category,
      CASE WHEN e = 1 THEN x END AS projection_id FROM (SELECT corpus, {KEY}, count(*) FILTER (WHERE assessment = 'exact') AS e, min(projection_id) FILTER (WHERE assessment = 'exact') AS x FROM s GROUP BY ALL)"""
)
def resolve_exact_keys(spark, sf_dir):
    return _resolved(spark, sf_dir, accepted=None).drop("losses")


@query(BOUND + resolution_sql("s", KEY, "r") + " SELECT * FROM rd")
def resolve_approximate_keys(spark, sf_dir):
    return _flat(_resolved(spark, sf_dir))


@query(BOUND + resolution_sql("a", ", ".join(bindings.AUTHORITY_KEY), "r") + " SELECT * FROM rd")
def resolve_authority_keys(spark, sf_dir):
    return _flat(_resolved(spark, sf_dir, "authority", bindings.AUTHORITY_KEY))


@query(
    BOUND + resolution_sql("s", KEY, "r") + ", " + CHOSEN.removeprefix("WITH ").replace(", c AS (", ", chosen AS (").replace("FROM c LEFT", "FROM chosen c LEFT").replace(", j AS (", ", jj AS (").replace("JOIN j ", "JOIN jj ").replace("FROM j ", "FROM jj ").replace("j.corpus", "j.corpus") .replace("LEFT JOIN jj USING", "LEFT JOIN jj j USING")
    + NAMED_GATES + " SELECT corpus, coalesce(problem, category) AS category, count(*) AS n FROM rd LEFT JOIN gates USING (corpus) GROUP BY 1, 2"
)
def resolution_refusals(spark, sf_dir):
    """Why keys aren't resolved, by corpus: a corpus that isn't executable refuses all of them for that reason."""
    return bindings.refuse_gated(_resolved(spark, sf_dir), _gates(spark, sf_dir)).groupBy("corpus", "category").agg(F.count("*").alias("n"))


REQUESTS = f"(SELECT DISTINCT CAST(floor(CAST(substr(target, 11) AS BIGINT) / 2) AS BIGINT) AS request, {KEY} FROM s)"


def _requests(bound):
    """Two neighbouring targets are a request."""
    number = F.floor(F.substring("target", 11, 20).cast("long") / 2)
    return bindings.index(bound, "semantic").select(number.alias("request"), *bindings.SEMANTIC_KEY).distinct()


#: Every request names both corpora, and each seventh one a corpus that nobody has compiled.
NAMED = ("parts", "suppliers")
ABSENT = "annals"
CONJOINED = (
    BOUND + resolution_sql("s", KEY, "r")
    + f""", q AS {REQUESTS}, named AS (SELECT request, unnest(CASE WHEN request % 7 = 0 THEN ['parts', 'suppliers', 'annals'] ELSE ['parts', 'suppliers'] END) AS corpus FROM (SELECT DISTINCT request FROM q)),
      every AS (SELECT request, corpus, {KEY}, coalesce(status, 'refused') AS status, CASE WHEN status IS NULL THEN 'semantic_tuple_absent' ELSE category END AS category, projection_id, coalesce(losses, '') AS losses
        FROM q JOIN named USING (request) LEFT JOIN rd USING (corpus, {KEY}))"""
)
MET = f""", met AS (SELECT request, corpus, count(*) AS n, bool_or(status = 'refused') AS refused, arg_min(category, ({KEY})) FILTER (WHERE status = 'refused') AS first_category, string_agg(losses, '+') FILTER (WHERE losses <> '') AS l FROM every GROUP BY 1, 2),
      w AS (SELECT request, corpus, CASE WHEN n < 2 OR refused THEN 'refused' WHEN l IS NOT NULL THEN 'approximate' ELSE 'exact' END AS status, CASE WHEN n < 2 THEN 'invalid_semantic_conjunction' ELSE first_category END AS category,
        CASE WHEN n < 2 OR refused THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(string_split(l, '+'))), '+'), '') END AS losses FROM met)"""


def _asked(spark, sf_dir, gated=None, capable=None):
    requests = _requests(_bound(spark, sf_dir))
    names = F.array(*map(F.lit, NAMED))
    corpora = requests.select("request").distinct().select("request", F.explode(F.when(F.col("request") % 7 == 0, F.array_append(names, F.lit(ABSENT))).otherwise(names)).alias("corpus"))
    return bindings.asked(_resolved(spark, sf_dir), requests, corpora, gated, capable)


@query(CONJOINED + " SELECT * FROM every")
def resolve_requests(spark, sf_dir):
    """Each key of each request in each corpus that it names; corpora without the key, or unknown ones, are refused rows."""
    return _flat(_asked(spark, sf_dir))


@query(
    FACTS + resolution_sql("s", KEY, "r") + ", " + CONJOINED[len(BOUND + resolution_sql("s", KEY, "r")) + 2:] + ", "
    + CHOSEN.removeprefix("WITH ").replace(", c AS (", ", chosen AS (").replace("FROM c LEFT", "FROM chosen c LEFT") + NAMED_GATES
    + f""", active AS (SELECT f.corpus, f.profile, f.capability, CASE WHEN reviewed_native_support = 0 THEN 'absent' WHEN problem IS NULL THEN 'active' ELSE 'unavailable' END AS state FROM facts f LEFT JOIN gates USING (corpus)),
      why AS (SELECT e.*, CASE WHEN gates.corpus IS NULL THEN 'missing_prerequisite' WHEN problem IS NOT NULL THEN problem WHEN coalesce(state, 'absent') = 'absent' THEN 'capability_absent' WHEN state <> 'active' THEN 'capability_unavailable' ELSE category END AS reason
        FROM every e LEFT JOIN gates USING (corpus) LEFT JOIN active USING (corpus, profile, capability))
    SELECT request, corpus, {KEY}, CASE WHEN reason IS NOT NULL THEN 'refused' ELSE status END AS status, reason AS category, CASE WHEN reason IS NULL THEN projection_id END AS projection_id, CASE WHEN reason IS NULL THEN losses ELSE '' END AS losses FROM why"""
)
def resolve_gated_requests(spark, sf_dir):
    """As resolve_requests, with the reasons that come first: corpora that aren't executable, capabilities that aren't active."""
    gated = _gates(spark, sf_dir)
    capable = bindings.capabilities(bindings.facts(table(spark, sf_dir, "mappings"), table(spark, sf_dir, "projections")), gated)
    return _flat(_asked(spark, sf_dir, gated, capable))


@query(CONJOINED + MET + " SELECT * FROM w")
def resolve_conjunctions(spark, sf_dir):
    """Requests of several keys in each corpus that they name, with what refuses them."""
    return _flat(bindings.conjunctions(_asked(spark, sf_dir)))


@query(
    CONJOINED + MET
    + """, t AS (SELECT request, bool_or(status = 'refused') AS refused, count(DISTINCT losses) FILTER (WHERE losses <> '') AS shapes FROM w GROUP BY 1)
    SELECT request, CASE WHEN refused THEN 'partial/non-executable' WHEN shapes = 0 THEN 'exactly-comparable' WHEN shapes = 1 THEN 'approximately-comparable' ELSE 'heterogeneous-loss' END AS state,
      NOT refused AND shapes <= 1 AS aggregate_allowed FROM t"""
)
def aggregate_permission(spark, sf_dir):
    """May a request's answers be added up over the corpora that it names, if the caller opts in."""
    return bindings.comparison(bindings.conjunctions(_asked(spark, sf_dir)), ["request"], opt_in=True)


@query(
    with_tables("external_refs")
    + """ SELECT corpus, authority_system, external, CASE WHEN n = 1 THEN 'resolved' WHEN n = 0 THEN 'no_executable_reference' ELSE 'multiple_references' END AS status, CASE WHEN n = 1 THEN x END AS reference_id
    FROM (SELECT corpus, authority_system, external, count(*) FILTER (WHERE identity_strength = 'same-entity') AS n, min(reference_id) FILTER (WHERE identity_strength = 'same-entity') AS x
      FROM external_refs WHERE reviewed AND reference_kind = 'entity-identity' AND authority_system IS NOT NULL GROUP BY 1, 2, 3)"""
)
def resolve_identities(spark, sf_dir):
    return bindings.resolve_references(table(spark, sf_dir, "external_refs"), "identity")


@query(
    with_tables("external_refs")
    + """ SELECT corpus, issuer, external, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'multiple_references' END AS status, CASE WHEN count(*) = 1 THEN min(reference_id) END AS reference_id
    FROM external_refs WHERE reviewed AND reference_kind = 'catalogue-identifier' AND issuer IS NOT NULL GROUP BY 1, 2, 3"""
)
def resolve_identifiers(spark, sf_dir):
    return bindings.resolve_references(table(spark, sf_dir, "external_refs"), "identifier")


@query(
    with_tables("external_refs")
    + """ SELECT reference_id, CASE WHEN reason IS NULL THEN 'resolvable' ELSE 'informative-only' END AS status, role, reason FROM (SELECT reference_id,
      CASE reference_kind WHEN 'entity-identity' THEN 'identity-filter' WHEN 'catalogue-identifier' THEN 'identifier-filter' WHEN 'provenance-source' THEN 'metadata/explanation' ELSE 'explanation-only' END AS role,
      CASE WHEN reference_kind = 'locator' THEN 'locator reference' WHEN reference_kind = 'provenance-source' THEN 'source/provenance reference' WHEN reference_kind = 'entity-identity' AND identity_strength <> 'same-entity' THEN identity_strength
        WHEN native_value IS NULL AND reference_kind = 'entity-identity' THEN 'no reviewed native identity selector' WHEN native_value IS NULL THEN 'identifier not queryable in native corpus' WHEN NOT reviewed THEN 'upstream execution prerequisites are not executable' END AS reason
      FROM external_refs)"""
)
def reference_policy(spark, sf_dir):
    refs = table(spark, sf_dir, "external_refs")
    status, role, reason = bindings.reference_policy(F.col("reference_kind"), F.col("identity_strength"), F.col("native_value"), F.col("reviewed"))
    return refs.select("reference_id", status.alias("status"), role.alias("role"), reason.alias("reason"))


@query(
    BOUND
    + """ SELECT projection_id, CASE WHEN shape = 'edge-path' THEN 'informative-only' WHEN assessment = 'exact' AND losses = '' THEN 'executable-exact'
      WHEN assessment IN ('close', 'broader', 'narrower') AND eligible AND losses IN ('undercoverage', 'overcoverage') THEN 'executable-approximate' WHEN assessment = 'close' AND eligible THEN 'executable-approximate' ELSE 'informative-only' END AS status FROM b"""
)
def atom_policy(spark, sf_dir):
    bound = _bound(spark, sf_dir)
    return bound.select("projection_id", bindings.atom_policy("approximate", ("overcoverage", "undercoverage"), F.col("shape") != "edge-path").alias("status"))


@query(
    BOUND
    + """, t AS (SELECT DISTINCT target FROM s WHERE corpus = 'suppliers' AND target IN ('urn:entry:0', 'urn:entry:2', 'urn:entry:3')),
    best AS (SELECT corpus, target, arg_min(assessment, (list_position(['exact', 'close', 'broader', 'narrower', 'related'], assessment), projection_id)) AS a FROM b WHERE target IN (SELECT target FROM t) GROUP BY 1, 2)
    SELECT corpus, CASE WHEN count(DISTINCT a) = 1 THEN min(a) ELSE 'conjunction:' || string_agg(DISTINCT a, '+' ORDER BY a) END AS strength FROM best GROUP BY corpus HAVING count(*) = (SELECT count(*) FROM t)"""
)
def best_candidates(spark, sf_dir):
    """Corpora with a binding for each of some targets, and how strong their best ones are."""
    bound = _bound(spark, sf_dir)
    wanted = bindings.index(bound, "semantic").where("corpus = 'suppliers' AND target IN ('urn:entry:0', 'urn:entry:2', 'urn:entry:3')").select("target")
    return bindings.best_candidates(bound, wanted)


# Execution

PART_NODE = "CAST(4000000000001 + p_partkey AS BIGINT)"


def _part_nodes(spark, sf_dir):
    return read(spark, sf_dir, "part").select((F.col("p_partkey") + 4000000000001).cast("long").alias("node"), F.concat("p_name", F.lit("#"), F.floor(F.col("p_partkey") / 2)).alias("value"))


@query(
    BOUND + resolution_sql("s", KEY, "r")
    + f" SELECT rd.corpus, rd.target, rd.status, rd.losses, {PART_NODE} AS node FROM rd JOIN b USING (corpus, projection_id) JOIN part ON p_name || '#' || CAST(floor(p_partkey / 2) AS BIGINT) = b.value WHERE rd.status <> 'refused' AND b.feature = 'label'"
)
def execute_approximate(spark, sf_dir):
    """Nodes of resolved keys with what they lose: one join of all selectors of a feature with its values."""
    return _flat(bindings.execute(_resolved(spark, sf_dir), _bound(spark, sf_dir), _part_nodes(spark, sf_dir), "part", "label"))


@query(
    BOUND + resolution_sql("a", ", ".join(bindings.AUTHORITY_KEY), "r")
    + f" SELECT rd.corpus, rd.target, rd.status, rd.losses, {PART_NODE} AS node FROM rd JOIN b USING (corpus, projection_id) JOIN part ON p_name || '#' || CAST(floor(p_partkey / 2) AS BIGINT) = b.value WHERE rd.status <> 'refused' AND b.feature = 'label'"
)
def execute_authority(spark, sf_dir):
    resolved = _resolved(spark, sf_dir, "authority", bindings.AUTHORITY_KEY)
    return _flat(bindings.execute(resolved, _bound(spark, sf_dir), _part_nodes(spark, sf_dir), "part", "label"))


SELECTED = ", " + with_tables("selectors", "selector_values", "selector_steps").removeprefix("WITH ") + """,
    nodes AS (SELECT CAST(1000000000001 + n_nationkey AS BIGINT) AS node, 'nation' AS t FROM nation UNION ALL SELECT CAST(2000000000001 + s_suppkey AS BIGINT), 'supplier' FROM supplier UNION ALL SELECT CAST(3000000000001 + c_custkey AS BIGINT), 'customer' FROM customer
      UNION ALL SELECT CAST(4000000000001 + p_partkey AS BIGINT), 'part' FROM part UNION ALL SELECT CAST(5000000000001 + o_orderkey AS BIGINT), 'order' FROM orders),
    stored AS (SELECT 'order_customer' AS edge, CAST(5000000000001 + o_orderkey AS BIGINT) AS src, CAST(3000000000001 + o_custkey AS BIGINT) AS dst, CAST(NULL AS VARCHAR) AS value FROM orders
      UNION ALL SELECT 'customer_nation', CAST(3000000000001 + c_custkey AS BIGINT), CAST(1000000000001 + c_nationkey AS BIGINT), NULL FROM customer UNION ALL SELECT 'supplier_nation', CAST(2000000000001 + s_suppkey AS BIGINT), CAST(1000000000001 + s_nationkey AS BIGINT), NULL FROM supplier
      UNION ALL SELECT 'order_part_flag', CAST(5000000000001 + l_orderkey AS BIGINT), CAST(4000000000001 + l_partkey AS BIGINT), min(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_partkey),
    turned AS (SELECT edge, 'outgoing' AS direction, src AS here, dst AS there, value FROM stored UNION ALL SELECT edge, 'incoming', dst, src, value FROM stored),
    listed AS (SELECT mapping_id, string_agg(value_type || ':' || value, '|' ORDER BY value_type, value) AS vals, count(*) AS n, count(DISTINCT value) AS distinct_n, min(value_type) AS kind FROM selector_values GROUP BY mapping_id),
    programs AS (SELECT mapping_id, string_agg(edge || '>' || direction || '>' || result_type || '>' || coalesce(match_values, ''), '|' ORDER BY step) AS program, bool_or(edge = 'order_parts') AS unknown, bool_or(match_values IS NOT NULL AND edge <> 'order_part_flag') AS unvalued FROM selector_steps GROUP BY mapping_id),
    judged AS (SELECT s.*, l.vals, g.program, CASE WHEN shape = 'closure' THEN 'unsupported_native_binding' WHEN node_type = 'warehouse' THEN 'node_type_missing' WHEN feature = 'p_colour' THEN 'feature_missing' WHEN shape LIKE 'value%' AND n <> distinct_n THEN 'value_set'
        WHEN shape LIKE 'value%' AND kind <> CASE feature WHEN 'p_size' THEN 'int' ELSE 'str' END THEN 'value_type' WHEN shape = 'edge-path' AND unknown THEN 'edge_missing' WHEN shape = 'edge-path' AND unvalued THEN 'edge_unvalued' END AS problem
      FROM selectors s LEFT JOIN listed l USING (mapping_id) LEFT JOIN programs g USING (mapping_id)),
    answers AS (SELECT DISTINCT node_type, feature, vals, program, md5(node_type || '/' || coalesce(feature, '') || '/' || coalesce(vals, '') || '/' || coalesce(program, '')) AS answer, first_value(mapping_id) OVER (PARTITION BY node_type, feature, vals, program ORDER BY mapping_id) AS one
      FROM (SELECT node_type, feature, CASE WHEN shape LIKE 'value%' THEN vals END AS vals, CASE WHEN shape = 'edge-path' THEN program END AS program, mapping_id FROM judged WHERE problem IS NULL)),
    walk AS (WITH RECURSIVE w AS (SELECT answer, 0 AS step, node FROM answers JOIN nodes ON t = node_type WHERE program IS NOT NULL
      UNION SELECT w.answer, w.step + 1, e.there FROM w JOIN answers a ON a.answer = w.answer JOIN selector_steps s ON s.mapping_id = a.one AND s.step = w.step JOIN turned e ON e.edge = s.edge AND e.direction = s.direction AND e.here = w.node
        JOIN nodes n ON n.node = e.there AND n.t = s.result_type WHERE s.match_values IS NULL OR list_contains(string_split(s.match_values, '+'), e.value)) SELECT * FROM w),
    selected AS (SELECT answer, node FROM answers JOIN nodes ON t = node_type WHERE program IS NULL AND vals IS NULL
      UNION ALL SELECT DISTINCT answer, CAST(4000000000001 + p_partkey AS BIGINT) FROM (SELECT answer, feature, unnest(string_split(vals, '|')) AS v FROM answers WHERE vals IS NOT NULL) JOIN part ON v = CASE feature WHEN 'p_brand' THEN 'str:' || p_brand WHEN 'p_type' THEN 'str:' || p_type ELSE 'int:' || CAST(p_size AS VARCHAR) END
      UNION ALL SELECT walk.answer, node FROM walk JOIN answers a ON a.answer = walk.answer WHERE step = (SELECT count(*) FROM selector_steps s WHERE s.mapping_id = a.one)),
    sums AS (SELECT answer, count(*) AS n_nodes, min(node) AS first_node, max(node) AS last_node, CAST(sum(node) AS BIGINT) AS node_sum FROM selected GROUP BY answer)"""


def _executed(spark, sf_dir):
    """The selectors of parts over the commerce graph, executed together."""
    named = lambda n: table(spark, sf_dir, n).withColumnRenamed("mapping_id", "plan_id")
    steps = named("selector_steps").withColumns({"match_values": F.split("match_values", r"\+"), "match_type": F.lit("str")})
    plans = executor.gathered(named("selectors"), named("selector_values"), steps)
    return executor.execute(spark, {"commerce": commerce(spark, sf_dir)}, plans)


@query(
    BOUND + resolution_sql("s", KEY, "r") + SELECTED
    + """ SELECT rd.corpus, rd.projection_id, rd.target, rd.status, rd.losses, CASE WHEN j.mapping_id IS NULL THEN 'missing_execution_component' ELSE j.problem END AS problem,
      CASE WHEN j.mapping_id IS NOT NULL AND j.problem IS NULL THEN coalesce(n_nodes, 0) END AS n_nodes, first_node, last_node, node_sum
    FROM rd JOIN b USING (corpus, projection_id) LEFT JOIN judged j ON j.mapping_id = b.mapping_id LEFT JOIN answers a ON j.problem IS NULL AND a.node_type = j.node_type AND a.feature IS NOT DISTINCT FROM j.feature
      AND a.vals IS NOT DISTINCT FROM CASE WHEN j.shape LIKE 'value%' THEN j.vals END AND a.program IS NOT DISTINCT FROM CASE WHEN j.shape = 'edge-path' THEN j.program END
      LEFT JOIN sums ON sums.answer = a.answer WHERE rd.status <> 'refused'"""
)
def execute_bindings(spark, sf_dir):
    """Resolved keys of all shapes with what they lose and the nodes that they select, summed up; refused ones with the reason."""
    done, bound = _executed(spark, sf_dir), _bound(spark, sf_dir)
    plans = _resolved(spark, sf_dir).where("status <> 'refused'").join(bound.select("corpus", "projection_id", F.col("mapping_id").alias("plan_id")), ["corpus", "projection_id"])
    found = accounting.exact_sums(done.nodes, ["answer"], {"node_sum": "node"}, F.count("*").alias("n_nodes"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))
    joined = plans.join(done.plans.select("plan_id", "answer", "problem", F.lit(True).alias("there")), "plan_id", "left").join(found, "answer", "left")
    problem = F.when(F.col("there").isNull(), "missing_execution_component").otherwise(F.col("problem"))
    return _flat(joined).select("corpus", "projection_id", "target", "status", "losses", problem.alias("problem"), F.when(F.col("answer").isNotNull(), F.coalesce("n_nodes", F.lit(0))).alias("n_nodes"), "first_node", "last_node", "node_sum")


@query(
    "WITH dummy AS (SELECT 1)" + SELECTED
    + """, one_of AS (SELECT a.answer, a.one, a.program FROM answers a WHERE program LIKE '%order_part_flag%')
    SELECT md5(program) AS program, s.step, CAST(sum(src) AS BIGINT) AS src_sum, CAST(sum(dst) AS BIGINT) AS dst_sum, count(*) AS n, count(value) AS n_valued, min(value) AS first_value, max(value) AS last_value
    FROM one_of JOIN selector_steps s ON s.mapping_id = one JOIN stored e ON e.edge = s.edge WHERE list_contains(string_split(s.match_values, '+'), e.value) GROUP BY program, s.step"""
)
def execution_evidence(spark, sf_dir):
    """The edges that valued walks kept, as they are stored, summed up for each distinct path and step."""
    done = _executed(spark, sf_dir)
    steps = table(spark, sf_dir, "selector_steps").withColumn("text", F.concat_ws(">", "edge", "direction", "result_type", F.coalesce("match_values", F.lit(""))))
    programs = steps.groupBy("mapping_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "text"))), lambda x: x["text"]), "|")).alias("program"), F.max((F.col("edge") == "order_part_flag").cast("int")).alias("valued"))
    known = done.plans.join(programs.where("valued = 1"), F.col("plan_id") == F.col("mapping_id")).select("answer", "program").distinct()
    layers = done.evidence.join(done.paths.withColumnRenamed("step", "at"), "path").where("step = at").join(known, "answer")
    others = F.count("*").alias("n"), F.count("value").alias("n_valued"), F.min("value").alias("first_value"), F.max("value").alias("last_value")
    return accounting.exact_sums(layers, ["program", "step"], {"src_sum": "src", "dst_sum": "dst"}, *others)


def _reference_nodes(spark, sf_dir, kind):
    refs = table(spark, sf_dir, "external_refs")
    found = bindings.resolve_references(refs, kind).where("status = 'resolved'").join(refs.select("reference_id", "mapping_id", "native_value"), "reference_id")
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("mapping_id"), (F.col("c_custkey") + 3000000000001).cast("long").alias("node"))
    return found.where("native_value IS NOT NULL").join(customers, "mapping_id").select("external", "reference_id", "node")


@query(
    with_tables("external_refs")
    + """, r AS (SELECT external, min(reference_id) AS reference_id FROM external_refs WHERE reviewed AND reference_kind = 'entity-identity' AND authority_system IS NOT NULL AND identity_strength = 'same-entity' GROUP BY external, authority_system HAVING count(*) = 1)
    SELECT r.external, reference_id, CAST(3000000000001 + CAST(substr(mapping_id, 2) AS BIGINT) AS BIGINT) AS node FROM r JOIN external_refs USING (reference_id) WHERE native_value IS NOT NULL"""
)
def execute_identity(spark, sf_dir):
    return _reference_nodes(spark, sf_dir, "identity")


@query(
    with_tables("external_refs")
    + """, r AS (SELECT external, min(reference_id) AS reference_id FROM external_refs WHERE reviewed AND reference_kind = 'catalogue-identifier' AND issuer IS NOT NULL GROUP BY external, issuer HAVING count(*) = 1)
    SELECT r.external, reference_id, CAST(3000000000001 + CAST(substr(mapping_id, 2) AS BIGINT) AS BIGINT) AS node FROM r JOIN external_refs USING (reference_id) WHERE native_value IS NOT NULL"""
)
def execute_identifier(spark, sf_dir):
    return _reference_nodes(spark, sf_dir, "identifier")


# Rules


@query(
    with_tables("mappings", "projections")
    + """ SELECT 'record_states' AS rule, mapping_id AS id, CASE WHEN native_state = 'positive' THEN 'target_missing' ELSE 'targets_forbidden' END AS problem
    FROM mappings m WHERE (native_state <> 'positive') = EXISTS (FROM projections p WHERE p.corpus = m.corpus AND p.mapping_id = m.mapping_id)"""
)
def record_state_violations(spark, sf_dir):
    return rules.record_states(table(spark, sf_dir, "mappings"), table(spark, sf_dir, "projections"), table(spark, sf_dir, "external_refs"))


@query(
    with_tables("projections")
    + """ SELECT 'kind_roles' AS rule, projection_id AS id, CASE WHEN formal_kind = 'property' THEN 'kind_role_conflict' ELSE 'invalid_projection' END AS problem
    FROM projections WHERE formal_kind = 'property' OR split_part(capability, '.', 1) <> profile"""
)
def kind_role_violations(spark, sf_dir):
    return rules.kind_roles(table(spark, sf_dir, "projections"))


@query(with_tables("projections") + " SELECT 'target_routing' AS rule, projection_id AS id, 'invalid_reference_routing' AS problem FROM projections WHERE (reference_kind = 'authority-value') <> (query_role = 'authority-value-filter')")
def target_routing_violations(spark, sf_dir):
    return rules.target_routing(table(spark, sf_dir, "projections"))


@query(
    with_tables("projections")
    + """ SELECT 'losses' AS rule, projection_id AS id, 'invalid_approximation' AS problem FROM projections WHERE (assessment IN ('exact', 'related') AND losses <> '') OR (eligible AND
    ((assessment = 'broader' AND losses <> 'undercoverage') OR (assessment = 'narrower' AND losses <> 'overcoverage') OR (assessment = 'close' AND losses = '')))"""
)
def loss_violations(spark, sf_dir):
    return rules.losses(table(spark, sf_dir, "projections"))


@query(with_tables("projections") + " SELECT 'publication' AS rule, projection_id AS id, 'invalid_publication_relation' AS problem FROM projections WHERE publication_relation LIKE '%skos%' OR (publication_relation LIKE '%Class' AND formal_kind <> 'class')")
def publication_violations(spark, sf_dir):
    return rules.publication(table(spark, sf_dir, "projections"))


@query(
    with_tables("external_refs")
    + """ SELECT 'reference_routing' AS rule, reference_id AS id, problem FROM (SELECT reference_id, CASE
      WHEN (reference_kind, query_role) NOT IN (('entity-identity', 'identity-filter'), ('catalogue-identifier', 'identifier-filter'), ('provenance-source', 'metadata-filter'), ('provenance-source', 'explanation-only'), ('locator', 'explanation-only')) THEN 'invalid_reference_routing'
      WHEN (reference_kind = 'entity-identity' AND authority_system IS NULL) OR (reference_kind = 'catalogue-identifier' AND issuer IS NULL) THEN 'invalid_reference_routing'
      WHEN publication_relation IS NOT NULL AND NOT (reference_kind = 'entity-identity' AND identity_strength = 'same-entity') THEN 'invalid_publication_relation'
      WHEN query_role <> 'explanation-only' AND native_value IS NULL THEN 'invalid_reference_routing' END AS problem FROM external_refs) WHERE problem IS NOT NULL"""
)
def reference_violations(spark, sf_dir):
    return rules.reference_routing(table(spark, sf_dir, "external_refs"))


@query(
    with_tables("mappings", "dependencies")
    + """ SELECT 'membership_authority' AS rule, mapping_id AS id, 'dependency_authority' AS problem FROM mappings m WHERE shape = 'membership'
      AND NOT EXISTS (FROM dependencies d WHERE d.mapping_id = m.mapping_id AND d.kind = 'node-type-present' AND d.node_type = m.node_type)
    UNION ALL SELECT 'path_authority', mapping_id, 'node_type_unproven' FROM mappings m WHERE shape = 'edge-path' AND NOT EXISTS (FROM dependencies d WHERE d.mapping_id = m.mapping_id AND d.kind = 'node-type-present' AND d.node_type = m.node_type)
    UNION ALL SELECT 'path_authority', mapping_id, 'path_unproven' FROM mappings m WHERE shape = 'edge-path' AND NOT EXISTS (FROM dependencies d WHERE d.mapping_id = m.mapping_id AND d.kind = 'path-present')
    UNION ALL SELECT 'value_set_authority', mapping_id, 'native_semantics_unproven' FROM mappings m WHERE shape = 'value-set-predicate' AND NOT EXISTS (FROM dependencies d WHERE d.mapping_id = m.mapping_id AND d.kind = 'native-value-present' AND d.value = m.value)"""
)
def dependency_violations(spark, sf_dir):
    mappings, needs = table(spark, sf_dir, "mappings"), table(spark, sf_dir, "dependencies")
    paths = rules.path_authority(mappings, needs, "part_supplier")
    return rules.membership_authority(mappings, needs).unionByName(paths).unionByName(rules.value_set_authority(mappings, needs))


@query(
    with_tables("selectors", "selector_steps")
    + """, s AS (SELECT s.*, CAST(substr(mapping_id, 2) AS BIGINT) AS k FROM selector_steps s), w AS (SELECT *, CAST(substr(mapping_id, 2) AS BIGINT) AS k FROM selectors WHERE shape = 'edge-path'),
    g AS (SELECT mapping_id, count(*) AS n, bool_or(match_values IS NOT NULL) AS valued, bool_or(match_values = 'A+R') AS both_values, bool_or(match_values = 'x' OR (edge = 'order_parts' AND match_values IS NOT NULL)) AS strange FROM s GROUP BY 1)
    SELECT 'ordered_path_authority' AS rule, mapping_id AS id, problem FROM (SELECT w.mapping_id, CASE WHEN k % 16 = 5 THEN 'node_type_unproven' WHEN k % 12 = 9 AND n > 1 THEN 'path_unproven'
      WHEN valued AND (strange OR k % 20 = 1 OR (k % 20 = 13 AND both_values)) THEN 'dependency_authority' END AS problem FROM w JOIN g USING (mapping_id)) WHERE problem IS NOT NULL"""
)
def ordered_path_violations(spark, sf_dir):
    """Edge paths whose types, order or values their own dependencies don't prove."""
    named = lambda n: table(spark, sf_dir, n).withColumnRenamed("mapping_id", "plan_id")
    steps = named("selector_steps").withColumns({"match_values": F.split("match_values", r"\+"), "match_type": F.lit("str")})
    plans = executor.gathered(named("selectors"), named("selector_values"), steps).withColumnRenamed("plan_id", "mapping_id")
    walks = plans.where("shape = 'edge-path'").withColumn("k", F.substring("mapping_id", 2, 20).cast("long"))
    k = F.col("k")
    types = walks.select("corpus", "mapping_id", "k", F.explode(F.concat(F.array("node_type"), F.transform("steps", lambda s: s["result_type"]))).alias("node_type"), F.col("node_type").alias("start"))
    types = types.where((k % 16 != 5) | (F.col("node_type") != F.col("start"))).select("corpus", "mapping_id", F.lit("node-type-present").alias("kind"), "node_type")
    way = F.transform("steps", lambda s: F.struct(s["edge"].alias("edge"), s["direction"].alias("direction")))
    paths = walks.select("corpus", "mapping_id", F.lit("path-present").alias("kind"), F.when(k % 12 == 9, F.reverse(way)).otherwise(way).alias("path"))
    # what a domain's edge runs between, as it is stored; some are written the way a step walks, some in parts
    valued = walks.select("corpus", "mapping_id", "k", "node_type", F.explode("steps").alias("s")).where("s.step = 0 AND s.match_values IS NOT NULL AND s.edge = 'order_part_flag'")
    ends = {"source": F.when(k % 20 == 1, F.col("s.result_type")).otherwise(F.col("node_type")), "target": F.when(k % 20 == 1, F.col("node_type")).otherwise(F.col("s.result_type"))}
    parts = F.when(k % 20 == 13, F.array(F.array(F.lit("R")), F.array(F.lit("A")))).otherwise(F.array(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
    domains = valued.select("corpus", "mapping_id", F.lit("edge-value-domain").alias("kind"), F.col("s.edge").alias("edge"), *(c.alias(n) for n, c in ends.items()), F.lit("str").alias("value_type"), F.explode(parts).alias("values"))
    needs = types.unionByName(paths, allowMissingColumns=True).unionByName(domains, allowMissingColumns=True)
    return rules.ordered_path_authority(plans, needs)


STEPS = "(SELECT l_orderkey, l_partkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1, 2)"


@query(
    f"""SELECT 'path_values_authority' AS rule, l_orderkey || '-' || l_partkey AS id, 'dependency_authority' AS problem FROM {STEPS} JOIN orders ON o_orderkey = l_orderkey
    WHERE NOT list_has_all(CASE o_orderstatus WHEN 'F' THEN ['A', 'N', 'R'] WHEN 'O' THEN ['A', 'R'] ELSE ['N'] END, flags)"""
)
def path_value_violations(spark, sf_dir):
    """Flags that an order's edge to a part may carry, by the order's status: one domain must cover all that are asked for."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.collect_set("l_returnflag").alias("values"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("source"))
    steps = line.join(orders, "l_orderkey").select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("mapping_id"), F.lit("flag").alias("edge"), "source", F.lit("part").alias("target"), "values")
    reviewed = F.when(F.col("source") == "F", F.array(*map(F.lit, "ANR"))).when(F.col("source") == "O", F.array(*map(F.lit, "AR"))).otherwise(F.array(F.lit("N")))
    domains = read(spark, sf_dir, "orders").select(F.lit("flag").alias("edge"), F.col("o_orderstatus").alias("source"), F.lit("part").alias("target")).distinct().withColumn("reviewed", reviewed)
    return rules.path_values_authority(steps, domains)


@query(
    with_tables("projections", "locks")
    + """ SELECT 'target_locks' AS rule, projection_id AS id, CASE WHEN lock_id NOT IN (SELECT lock_id FROM locks) THEN 'missing_reference' ELSE 'unknown_ontology_target' END AS problem
    FROM projections p WHERE NOT EXISTS (FROM locks l WHERE l.lock_id = p.lock_id AND l.term = p.target)"""
)
def lock_violations(spark, sf_dir):
    return rules.target_locks(table(spark, sf_dir, "projections"), table(spark, sf_dir, "locks"))


BRIDGES = "(SELECT concat('b', p_partkey) AS bridge_id, concat('lock', p_size % 3) AS source_lock, concat('urn:entry:', p_partkey // 3) AS source_term, concat('d', p_size % 3) AS source_digest, concat('lock', (p_size + 1) % 3) AS target_lock, concat('urn:entry:', p_partkey // 3 + 1) AS target_term, concat('d', p_size % 2) AS target_digest FROM part)"


@query(
    with_tables("locks")
    + f""", e AS (SELECT bridge_id, 'source' AS x, source_lock AS lock_id, source_term AS term, source_digest AS said FROM {BRIDGES} UNION ALL SELECT bridge_id, 'target', target_lock, target_term, target_digest FROM {BRIDGES})
    SELECT 'bridges' AS rule, bridge_id AS id, CASE WHEN content_digest IS NULL THEN x || '_missing' ELSE x || '_digest_mismatch' END AS problem FROM e LEFT JOIN locks USING (lock_id, term) WHERE content_digest IS DISTINCT FROM said"""
)
def bridge_violations(spark, sf_dir):
    third = lambda n: F.concat(F.lit("urn:entry:"), F.floor(F.col("p_partkey") / 3) + n)
    of = lambda head, value: F.concat(F.lit(head), value.cast("string"))
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part").select(
        of("b", F.col("p_partkey")).alias("bridge_id"),
        of("lock", size % 3).alias("source_lock"), third(0).alias("source_term"), of("d", size % 3).alias("source_digest"),
        of("lock", (size + 1) % 3).alias("target_lock"), third(1).alias("target_term"), of("d", size % 2).alias("target_digest"),
    )
    return rules.bridges(rows, table(spark, sf_dir, "locks"))


@query(
    """SELECT 'evidence' AS rule, CAST(l.doc_id AS VARCHAR) AS id, CASE WHEN d.doc_id IS NULL THEN 'missing_reference' ELSE 'evidence_digest_mismatch' END AS problem
    FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + l.toxic * 1000000 WHERE d.doc_id IS NULL OR (l.quality = 0 AND length(d.text) <> d.n_chars + 1) OR (l.quality = 1 AND length(d.text) <> d.n_chars)"""
)
def evidence_violations(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    bound = labels.select("doc_id", (F.col("doc_id") + F.col("toxic") * 1000000).alias("evidence_id"), F.col("quality"))
    docs = read(spark, sf_dir, "documents")
    sizes = docs.select(F.col("doc_id").alias("evidence_id"), F.col("n_chars"), F.length("text").cast("string").alias("content_digest"))
    said = bound.join(sizes.select("evidence_id", "n_chars"), "evidence_id", "left")
    said = said.select(F.col("doc_id").alias("id"), "evidence_id", F.when(F.col("quality") == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast("string").alias("content_digest"))
    return rules.evidence(said, sizes)


MANIFEST = (
    "i AS (SELECT DISTINCT 'value:' || p_brand AS item_id, 'value' AS kind, 0 AS t FROM part UNION ALL SELECT DISTINCT 'kind:' || p_type, 'value', 0 FROM part),"
    " x AS (SELECT DISTINCT 'value:' || p_brand AS item_id, 'value' AS kind, 1 AS t FROM part WHERE p_size = 7), g AS (SELECT 'feature:' || p_name AS item_id, 'feature' AS kind, 2 AS t FROM part), r AS (FROM i UNION ALL FROM x UNION ALL FROM g)"
)


@query(
    f"""WITH {MANIFEST} SELECT 'manifest' AS rule, item_id AS id, 'item_identity_mismatch' AS problem FROM r WHERE NOT starts_with(item_id, kind || ':')
    UNION ALL SELECT 'manifest', item_id, CASE WHEN count(DISTINCT t) > 1 THEN 'denominator_overlap' ELSE 'duplicate_id' END FROM r GROUP BY item_id HAVING count(*) > 1"""
)
def manifest_violations(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    rows = lambda head, c, kind: part.select(F.concat(F.lit(head), c).alias("item_id"), F.lit(kind).alias("kind"))
    items = rows("value:", "p_brand", "value").distinct().unionByName(rows("kind:", "p_type", "value").distinct())
    technical = part.where("p_size = 7").select(F.concat(F.lit("value:"), "p_brand").alias("item_id"), F.lit("value").alias("kind")).distinct()
    return rules.manifest(items, technical, rows("feature:", "p_name", "feature"))


@query(
    with_tables("projections")
    + """ SELECT 0 AS stage, 'kind_roles' AS rule, projection_id AS id, CASE WHEN formal_kind = 'property' THEN 'kind_role_conflict' ELSE 'invalid_projection' END AS problem
    FROM projections WHERE formal_kind = 'property' OR split_part(capability, '.', 1) <> profile"""
)
def first_stage_problems(spark, sf_dir):
    """The problems of the first stage of a bundle's rules that has any."""
    projections = table(spark, sf_dir, "projections")
    return rules.pipeline([rules.kind_roles(projections), rules.target_routing(projections), rules.losses(projections)])


@query(
    with_tables("projections")
    + """ SELECT 'kind_roles' AS rule, projection_id AS id, CASE WHEN formal_kind = 'property' THEN 'kind_role_conflict' ELSE 'invalid_projection' END AS problem
    FROM projections WHERE formal_kind = 'property' OR split_part(capability, '.', 1) <> profile ORDER BY projection_id LIMIT 1"""
)
def first_problem(spark, sf_dir):
    return rules.first_problem(rules.kind_roles(table(spark, sf_dir, "projections")))


# Changes


@query(
    with_tables("locks")
    + """ SELECT p.corpus || p.mapping_id AS mapping_id, p.target, e.n_chars AS evidence_digest, CASE WHEN e.n_chars IS NULL THEN 'missing_evidence' WHEN p.target NOT IN (SELECT term FROM locks) THEN 'unknown_target' END AS problem
    FROM (SELECT 'parts' AS corpus, concat('p', p_partkey) AS mapping_id, concat('urn:entry:', p_partkey // 3) AS target, p_partkey AS evidence_id FROM part) p LEFT JOIN documents e ON e.doc_id = p.evidence_id"""
)
def candidate_proposals(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    decisions = part.select(F.concat(F.lit("partsp"), "p_partkey").alias("mapping_id"), F.concat(F.lit("urn:entry:"), F.floor(F.col("p_partkey") / 3)).alias("target"), F.col("p_partkey").alias("evidence_id"))
    evidence = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("n_chars").alias("content_digest"))
    return changes.proposals(decisions, evidence, table(spark, sf_dir, "locks"))


@query("SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 10 THEN 'batch_too_large' WHEN count(*) > count(DISTINCT o_orderpriority) THEN 'duplicate_mapping' END AS problem FROM orders GROUP BY 1")
def proposal_batches(spark, sf_dir):
    decisions = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("mapping_id"))
    return changes.batches(decisions, "o_custkey", 10)


@query("""SELECT p_partkey, p_name, 'sha256:' || sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS commitment FROM part""")
def review_packet(spark, sf_dir):
    return changes.packet(read(spark, sf_dir, "part"), ["p_size", "p_name", "p_brand"]).select("p_partkey", "p_name", "commitment")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'missing' WHEN p_size > 45 THEN 'added' ELSE 'changed' END AS state FROM part WHERE p_size < 10 OR p_size > 45 OR (p_size % 5 = 0)")
def release_parity(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rebuilt = part.where("p_size >= 10").withColumn("p_name", F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return changes.parity(rebuilt, part.where("p_size <= 45"), "p_partkey", ["p_name", "p_size"])


EVENTS = "(SELECT user_id % 7 AS item, user_id AS reviewer, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'pending' WHEN 'click' THEN 'accept' ELSE 'reject' END AS state, ts, event_id AS id FROM events)"


def _reviews(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "error", "pending").when(kind.isin("purchase", "click"), "accept").otherwise("reject")
    return read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("item"), F.col("user_id").cast("string").alias("reviewer"), state.alias("state"), "ts", F.col("event_id").alias("id"))


@query(
    f"""SELECT item, count(*) AS reviewers, CASE WHEN count(*) < 2 THEN 'incomplete' WHEN count(DISTINCT state) > 1 THEN 'disputed' ELSE max(state) END AS status
    FROM (SELECT item, reviewer, arg_max(state, (ts, id)) AS state FROM {EVENTS} WHERE state <> 'pending' AND reviewer <> item GROUP BY 1, 2) GROUP BY 1"""
)
def review_decisions(spark, sf_dir):
    """The last word of each reviewer on each item, and what they come to; nobody decides their own item."""
    reviews = _reviews(spark, sf_dir)
    return changes.decided(reviews.withColumn("author", F.col("item").cast("string")), "item", F.col("reviewer"), F.col("author"))


@query(
    f"""SELECT item, CASE WHEN n > 1 THEN s[n - 1] ELSE s[1] END AS first, CASE WHEN n > 1 THEN s[n] END AS second, CASE WHEN n < 2 THEN 'incomplete' WHEN s[n - 1] = 'accept' AND s[n] = 'accept' THEN 'accept' ELSE 'reject' END AS status
    FROM (SELECT item, list(state ORDER BY ts, id) AS s, count(*) AS n FROM {EVENTS} WHERE state <> 'pending' GROUP BY 1)"""
)
def two_pass_reviews(spark, sf_dir):
    return changes.two_passes(_reviews(spark, sf_dir), "item")


@query(
    "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 'id' WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 3) THEN 'binding' END AS taken FROM part"
)
def overlay_handoff(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    old = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("string").alias("binding"))
    inherited = old.unionByName(part.where("p_size = 3").select(F.lit(None).cast("long").alias("id"), F.col("p_name").alias("binding")))
    found = changes.handoff(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("binding")), inherited, ("id", "binding"))
    return found.select(F.col("id").alias("p_partkey"), "taken")


@query(
    with_tables("mappings")
    + """, t AS (SELECT mapping_id, mapping_id || 'n' AS new_id, 'urn:new:' || mapping_id AS target FROM mappings WHERE corpus = 'parts' AND CAST(substr(mapping_id, 2) AS BIGINT) % 4 = 3), m AS (SELECT * FROM mappings WHERE corpus = 'parts')
    SELECT m.mapping_id, native_state, CAST(NULL AS VARCHAR) AS target, CASE WHEN new_id IS NULL THEN 'kept' WHEN native_state = 'native-only' THEN 'retired' ELSE 'refused' END AS action FROM m LEFT JOIN t USING (mapping_id)
    UNION ALL SELECT new_id, 'positive', target, 'added' FROM m JOIN t USING (mapping_id) WHERE native_state = 'native-only'"""
)
def supersession_preview(spark, sf_dir):
    active = table(spark, sf_dir, "mappings").where("corpus = 'parts'").select("mapping_id", "native_state")
    moving = active.where("CAST(substr(mapping_id, 2) AS BIGINT) % 4 = 3")
    transitions = moving.select("mapping_id", F.concat("mapping_id", F.lit("n")).alias("new_id"), F.concat(F.lit("urn:new:"), "mapping_id").alias("target"))
    return changes.supersede(active, transitions)


@query(
    """SELECT 'part' AS key, CAST(l_partkey AS VARCHAR) AS value, l_orderkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_orderkey HAVING count(*) > 1
    UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), l_orderkey, count(*) FROM lineitem GROUP BY l_suppkey, l_orderkey HAVING count(*) > 1"""
)
def transition_conflicts(spark, sf_dir):
    """What a batch (here an order) may have once only: keys that it has more often."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return changes.transition_problems(line, ("part", "supplier"), "l_orderkey")


@query("SELECT c_custkey AS id FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey <> s_nationkey")
def shadowed_evidence(spark, sf_dir):
    new = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("digest"))
    return changes.shadowed(new, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("digest")), "id", "digest")


@query("SELECT s_suppkey AS id, s_nationkey AS digest FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def merged_evidence(spark, sf_dir):
    new = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("digest"))
    return changes.merged(new, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("digest")), "id")


SUCCESSOR = "(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN o_orderpriority = '1-URGENT' THEN 'new' END AS label, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS changed FROM orders)"


def _successor(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return orders, changes.successor(orders, F.col("o_orderpriority") == "1-URGENT", "label", F.lit("new"))


@query(f"SELECT * FROM {SUCCESSOR}")
def successor_manifest(spark, sf_dir):
    return _successor(spark, sf_dir)[1].select("o_orderkey", "label", "changed")


@query(f"SELECT count(*) AS items, count(label) AS reviewed, count(*) FILTER (WHERE label = 'new') AS added, count(*) FILTER (WHERE label IS NULL) AS open, 0 AS problems FROM {SUCCESSOR}")
def successor_totals(spark, sf_dir):
    """A successor's totals, and how many of its items changed though they may not."""
    old, new = _successor(spark, sf_dir)
    problems = changes.successor_problems(old, new, "o_orderkey", "label").agg(F.count("*").cast("int").alias("problems"))
    return accounting.totals(new, "label", {"added": F.col("label") == "new", "open": F.col("label").isNull()}).join(F.broadcast(problems))


# Accounting

ACCOUNTS = with_tables("mappings", "projections") + (
    ", i AS (SELECT DISTINCT corpus, node_type || ':' || feature || '=' || value AS item_id FROM mappings WHERE native_state <> 'unsupported'),"
    " l AS (SELECT p.corpus, node_type || ':' || feature || '=' || value AS item_id, assessment, p.reviewed AND m.reviewed AS production, target FROM projections p JOIN mappings m USING (corpus, mapping_id))"
)


def _accounts(spark, sf_dir):
    mappings, projections = table(spark, sf_dir, "mappings"), table(spark, sf_dir, "projections")
    item = F.concat("node_type", F.lit(":"), "feature", F.lit("="), "value").alias("item_id")
    items = mappings.where("native_state <> 'unsupported'").select("corpus", item).distinct()
    seen = mappings.select("corpus", "mapping_id", item, F.col("reviewed").alias("_seen"))
    return items, projections.join(seen, ["corpus", "mapping_id"]).select("corpus", "item_id", "assessment", (F.col("reviewed") & F.col("_seen")).alias("production"), "target")


LABELLED = (
    ", said AS (SELECT corpus, item_id, string_agg(DISTINCT assessment, '+' ORDER BY assessment) AS a, count(DISTINCT assessment) AS k, count(target) > 0 AS common FROM l GROUP BY 1, 2),"
    " t AS (SELECT corpus, item_id, CASE WHEN k > 1 THEN 'mixed:' || a ELSE a END AS label, coalesce(common, false) AS common FROM i LEFT JOIN said USING (corpus, item_id))"
)


@query(ACCOUNTS + LABELLED + " SELECT corpus, count(*) AS items, count(label) AS reviewed, count(*) FILTER (WHERE common) AS common, count(*) - count(label) AS unreviewed, round(100.0 * count(label) / count(*), 2) AS pct FROM t GROUP BY ROLLUP (corpus)")
def schema_coverage(spark, sf_dir):
    """Items, and how many of them links review or share a target of, by corpus and in all."""
    return accounting.schema_coverage(accounting.labelled(*_accounts(spark, sf_dir)))


@query(ACCOUNTS + LABELLED + " SELECT corpus, label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY GROUPING SETS ((corpus, label), (label))")
def schema_labels(spark, sf_dir):
    """What links say of items: one assessment, or mixed ones, by corpus and in all."""
    found = accounting.labelled(*_accounts(spark, sf_dir)).where("label IS NOT NULL")
    by_corpus = found.groupBy("corpus", "label").agg(F.count("*").alias("n"))
    return by_corpus.unionByName(by_corpus.groupBy(F.lit(None).cast("string").alias("corpus"), "label").agg(F.sum("n").alias("n")))


@query(with_tables("projections") + " SELECT corpus, assessment, target, count(*) AS n FROM projections GROUP BY ALL")
def projection_histogram(spark, sf_dir):
    """Projections by corpus, assessment and target."""
    return table(spark, sf_dir, "projections").groupBy("corpus", "assessment", "target").agg(F.count("*").alias("n"))


@query("SELECT doc_id + 40 AS doc_id, 'patch' AS part FROM labels WHERE doc_id + 40 NOT IN (SELECT doc_id FROM documents) UNION SELECT doc_id + 90, 'exclude' FROM labels WHERE toxic = 1 AND doc_id + 90 NOT IN (SELECT doc_id FROM documents)")
def override_unknown(spark, sf_dir):
    """Overrides of items that aren't there."""
    labels = read(spark, sf_dir, "labels")
    shifted = lambda rows, by: rows.select((F.col("doc_id") + by).alias("doc_id"))
    return accounting.unknown_overrides(read(spark, sf_dir, "documents"), shifted(labels.where("toxic = 1"), 90), shifted(labels, 40), "doc_id")


@query(
    ACCOUNTS
    + """ SELECT corpus, count(*) AS items, count(r) AS research_reviewed, count(*) FILTER (WHERE r > 0) AS research_common, count(p) AS production_reviewed, count(*) FILTER (WHERE p > 0) AS production_common, count(*) FILTER (WHERE p IS NULL) AS production_unreviewed
    FROM i LEFT JOIN (SELECT corpus, item_id, count(target) AS r, CASE WHEN count(*) FILTER (WHERE production) > 0 THEN count(target) FILTER (WHERE production) END AS p FROM l GROUP BY 1, 2) USING (corpus, item_id) GROUP BY corpus"""
)
def coverage_authorities(spark, sf_dir):
    """Coverage by both authorities: research counts all links, production those that are reviewed."""
    return accounting.coverage_authorities(*_accounts(spark, sf_dir))


@query(ACCOUNTS + " SELECT corpus, assessment, count(DISTINCT item_id) AS n FROM l JOIN i USING (corpus, item_id) WHERE production GROUP BY 1, 2")
def assessment_histogram(spark, sf_dir):
    items, links = _accounts(spark, sf_dir)
    return accounting.assessment_histogram(items, links.where("production"))


@query(
    ACCOUNTS
    + """ SELECT corpus, item_id, EXISTS (FROM i WHERE i.corpus = l.corpus AND i.item_id = l.item_id) AS inside, string_agg(DISTINCT assessment, '+' ORDER BY assessment) AS assessments FROM l WHERE production GROUP BY corpus, item_id"""
)
def production_split(spark, sf_dir):
    """Production's accounting inside and outside the denominator."""
    items, links = _accounts(spark, sf_dir)
    return accounting.split(links.where("production"), items, ["corpus", "item_id"])


@query(
    """SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN 'C' WHEN c_mktsegment = 'BUILDING' THEN 'D' WHEN c_mktsegment = 'MACHINERY' THEN 'E' ELSE 'H' END AS owner FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def residual_routes(spark, sf_dir):
    """An explicit policy first, what was assessed next, the default last."""
    policy = read(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("C").alias("owner"))
    segment = F.col("c_mktsegment")
    assessed = F.when(segment == "BUILDING", "D").when(segment == "MACHINERY", "E")
    return accounting.route(read(spark, sf_dir, "customer"), policy, "c_nationkey", assessed=assessed).select("c_custkey", "owner")


@query(
    """SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS extra, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS missed,
    CASE WHEN count(*) FILTER (WHERE quality = 1 AND toxic = 1) > 0 AND count(*) FILTER (WHERE quality = 0 AND toxic = 0) > 0 THEN 'mixed' WHEN count(*) FILTER (WHERE quality = 1 AND toxic = 1) > 0 THEN 'overcoverage'
      WHEN count(*) FILTER (WHERE quality = 0 AND toxic = 0) > 0 THEN 'undercoverage' ELSE 'exact' END AS state FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 0 GROUP BY lang"""
)
def inclusion_witnesses(spark, sf_dir):
    """How the good documents of a language lie to those that aren't toxic."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return sets.inclusion(rows.where("quality = 1").select("lang", "doc_id"), rows.where("toxic = 0").select("lang", "doc_id"), ["lang"], "doc_id")


# Digests


@query(
    """SELECT o_custkey, 'sha256:' || sha256('[' || string_agg('{"file_sha256":"sha256:' || sha256(o_orderpriority) || '","logical_path":"' || o_orderstatus || '/' || o_orderkey || '"}', ',' ORDER BY o_orderstatus || '/' || o_orderkey) || ']') AS digest
    FROM orders GROUP BY 1"""
)
def bundle_digests(spark, sf_dir):
    """The digest of each customer's orders as a bundle of files."""
    files = read(spark, sf_dir, "orders").select("o_custkey", F.concat_ws("/", "o_orderstatus", "o_orderkey").alias("path"), digests.text_digest(F.col("o_orderpriority")).alias("file"))
    return digests.bundle_digest(files, ["o_custkey"], "path", "file")


@query(
    """SELECT o_orderkey, 'sha256:' || sha256('{"feature":"flag","node_type":"order","values":["' || array_to_string(list_sort(list_distinct(list(l_returnflag))), '","') || '"]}') AS identity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def binding_identities(spark, sf_dir):
    """Identities of value sets: the order of the values makes no difference."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("values"))
    line = line.join(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return line.select("o_orderkey", digests.binding_identity(F.lit("order"), F.lit("flag"), F.col("values")).alias("identity"))


@query(with_tables("native_values") + " SELECT corpus, mapping_id, value_present, CASE WHEN value_present THEN value END AS value, CASE WHEN NOT value_present THEN 'absent' WHEN value IS NULL THEN 'null' ELSE 'given' END AS state FROM native_values")
def native_bindings(spark, sf_dir):
    """Selectors as bindings, where a value that isn't there differs from one that is null."""
    return bindings.native(table(spark, sf_dir, "native_values")).select("corpus", "mapping_id", "value_present", "value", "state")


@query("SELECT conv_id, turn, try_cast(json_extract_string(j, '$.decision') AS VARCHAR) AS decision, CAST(json_extract(j, '$.turn') AS BIGINT) AS said FROM (SELECT conv_id, turn, '{\"decision\":\"' || role || '\",\"turn\":' || turn || '}' AS j FROM conversations)")
def structured_bodies(spark, sf_dir):
    """Bodies with a marker line and a JSON document after it."""
    body = F.concat(F.lit("text\nDECISION\n"), F.to_json(F.struct(F.col("role").alias("decision"), F.col("turn").alias("turn"))))
    parsed = accounting.structured(F.col("body"), "DECISION", "decision string, turn long")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body")).withColumn("p", parsed)
    return rows.select("conv_id", "turn", "p.decision", F.col("p.turn").alias("said"))


# Contexts


@query(
    """SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'several_variants' WHEN count(*) > count(DISTINCT l_partkey) THEN 'duplicate_component' END AS problem
    FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1 OR count(*) > count(DISTINCT l_partkey)"""
)
def context_problems(spark, sf_dir):
    """Corpora (here orders) that were loaded as several variants, or with a component twice."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("variant"), F.col("l_partkey").alias("component_id"))
    return bindings.context_problems(line, "l_orderkey")


@query("SELECT event_id, epoch_us(ts) AS at FROM events")
def review_times(spark, sf_dir):
    """Times that reviews write as text, as keys that sort; null where they are none."""
    written = read(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("text"))
    return written.select("event_id", F.unix_micros(ordering.time_key(F.col("text"))).alias("at"))
