"""Rules of bundles as queries for what breaks them: each gives (rule, id, problem), and a sound bundle gives none.

Rules that look at one row are projections; those that need another table are semi- and anti-joins on its keys, so
none of them brings a table to one place.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.plans.bindings import ASSESSMENTS, SUBSTITUTES, TARGET_ROUTING

#: Which roles a formal kind may have.
ROLES_OF_KIND = {
    "class": ("entity-type", "annotation-category", "annotation-value"),
    "property": ("relation", "attribute", "annotation-category"),
    "skos-concept": ("annotation-value", "lexical-concept-identity", "authority-reference"),
    "named-resource": (
        "lexical-entry-identity", "lexical-form-identity", "lexical-sense-identity", "lexical-concept-identity", "authority-reference", "claim-proposition", "inference-activity",
    ),
}
#: Kinds of external references with the query roles that they may have.
REFERENCE_ROUTING = (
    ("entity-identity", "identity-filter"), ("catalogue-identifier", "identifier-filter"), ("provenance-source", "metadata-filter"), ("provenance-source", "explanation-only"), ("locator", "explanation-only"),
)
STRENGTHS = ("same-entity", "probable-same-entity", "related-record", "ambiguous-identity")
OWL, RDFS, SKOS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#"
#: Relations that may be published, by the formal kind of the target.
PUBLISHED = {
    "class": (f"{OWL}equivalentClass", f"{RDFS}subClassOf"),
    "property": (f"{OWL}equivalentProperty", f"{RDFS}subPropertyOf"),
    "skos-concept": tuple(f"{SKOS}{x}Match" for x in ("exact", "close", "broad", "narrow", "related")),
}


def _broken(rows: DataFrame, rule: str, key: str, problem: Column) -> DataFrame:
    """Rows whose problem isn't null."""
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"), problem.alias("problem")).where("problem IS NOT NULL")


def _lacks(rows: DataFrame, there: DataFrame, on: list[str], rule: str, key: str, problem: str) -> DataFrame:
    """Rows without a partner."""
    return _broken(rows.join(there.select(*on).distinct(), on, "left_anti"), rule, key, F.lit(problem))


def repeated_ids(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Ids that a bundle has twice."""
    return _broken(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "unique_ids", key, F.lit("duplicate_id"))


def unknown_words(rows: DataFrame, vocabulary: DataFrame, column: str, key: str) -> DataFrame:
    """Values of a column that a vocabulary (a table with that column) doesn't have."""
    return _lacks(rows, vocabulary, [column], "vocabulary", key, "unknown_vocabulary")


def record_states(mappings: DataFrame, projections: DataFrame, refs: DataFrame) -> DataFrame:
    """Records without a target have no projections; positive ones have a projection or a reference."""
    n = projections.groupBy("corpus", "mapping_id").agg(F.count("*").alias("_projections"))
    others = refs.select("corpus", "mapping_id").distinct().withColumn("_referred", F.lit(True))
    joined = mappings.join(n, ["corpus", "mapping_id"], "left").join(others, ["corpus", "mapping_id"], "left")
    has, state = F.coalesce(F.col("_projections"), F.lit(0)) > 0, F.col("native_state")
    problem = F.when(state.isin("native-only", "unsupported", "ambiguous") & has, "targets_forbidden").when((state == "positive") & ~has & F.col("_referred").isNull(), "target_missing")
    return _broken(joined, "record_states", "mapping_id", problem)


def kind_roles(projections: DataFrame) -> DataFrame:
    """Kinds with a role that they can't have, and capabilities that their profile doesn't scope."""
    legal = functools.reduce(Column.__or__, ((F.col("formal_kind") == k) & F.col("semantic_role").isin(*roles) for k, roles in ROLES_OF_KIND.items()))
    scoped = F.substring_index("capability", ".", 1) == F.col("profile")
    return _broken(projections, "kind_roles", "projection_id", F.when(~F.coalesce(legal, F.lit(False)), "kind_role_conflict").when(~F.coalesce(scoped, F.lit(False)), "invalid_projection"))


def target_routing(projections: DataFrame) -> DataFrame:
    """Pairs of reference kind and query role that aren't a target's, and unknown assessments."""
    legal = functools.reduce(Column.__or__, ((F.col("reference_kind") == k) & (F.col("query_role") == r) for k, r in TARGET_ROUTING))
    return _broken(projections, "target_routing", "projection_id", F.when(~F.coalesce(legal, F.lit(False)), "invalid_reference_routing").when(~F.coalesce(F.col("assessment").isin(*ASSESSMENTS), F.lit(False)), "unknown_vocabulary"))


def losses(projections: DataFrame) -> DataFrame:
    """What eligible approximations lose: broader ones miss something, narrower ones have too much, close ones either."""
    sorted_losses = F.array_sort(F.filter(F.split("losses", r"\+"), lambda x: x != ""))
    is_ = lambda *x: sorted_losses == F.array(*map(F.lit, x))
    kind, known = F.col("assessment"), F.size(F.array_except(sorted_losses, F.array(F.lit("overcoverage"), F.lit("undercoverage")))) == 0
    wrong = ((kind == "broader") & ~is_("undercoverage")) | ((kind == "narrower") & ~is_("overcoverage")) | ((kind == "close") & (F.size(sorted_losses) == 0))
    problem = F.when(~known, "unknown_vocabulary").when(~kind.isin(*SUBSTITUTES) & (F.size(sorted_losses) > 0), "invalid_approximation").when(F.col("eligible") & wrong, "invalid_approximation")
    return _broken(projections, "losses", "projection_id", problem)


def publication(projections: DataFrame) -> DataFrame:
    """Published relations that the target's formal kind can't have."""
    legal = functools.reduce(Column.__or__, ((F.col("formal_kind") == k) & F.col("publication_relation").isin(*relations) for k, relations in PUBLISHED.items()))
    return _broken(projections, "publication", "projection_id", F.when(F.col("publication_relation").isNotNull() & ~F.coalesce(legal, F.lit(False)), "invalid_publication_relation"))


def reference_routing(refs: DataFrame) -> DataFrame:
    """External references: routing first, then what their kind must have and what it may publish."""
    kind, relation = F.col("reference_kind"), F.col("publication_relation")
    legal = functools.reduce(Column.__or__, ((kind == k) & (F.col("query_role") == r) for k, r in REFERENCE_ROUTING))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    entity, identifier = kind == "entity-identity", kind == "catalogue-identifier"
    same = (relation == f"{OWL}sameAs") & (F.col("identity_strength") == "same-entity")
    problem = (
        F.when(~F.coalesce(legal, F.lit(False)) | empty("external"), "invalid_reference_routing")
        .when((entity & empty("authority_system")) | (identifier & empty("issuer")), "invalid_reference_routing")
        .when(entity & ~F.coalesce(F.col("identity_strength").isin(*STRENGTHS), F.lit(False)), "unknown_vocabulary")
        .when(relation.isNotNull() & ~F.coalesce(entity & same, F.lit(False)), "invalid_publication_relation")
        .when(F.col("query_role").isin("identity-filter", "identifier-filter", "metadata-filter") & F.col("native_value").isNull(), "invalid_reference_routing")
    )
    return _broken(refs, "reference_routing", "reference_id", problem)


def membership_authority(mappings: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Memberships whose node type isn't among their own dependencies."""
    rows, there = mappings.where("shape = 'membership'"), dependencies.where("kind = 'node-type-present'")
    return _lacks(rows, there, ["corpus", "mapping_id", "node_type"], "membership_authority", "mapping_id", "dependency_authority")


def path_authority(mappings: DataFrame, dependencies: DataFrame, steps: str) -> DataFrame:
    """Edge paths need their start's type and the whole path, as one string, among their own dependencies."""
    rows = mappings.where("shape = 'edge-path'").withColumn("feature", F.lit(steps))
    types = _lacks(rows, dependencies.where("kind = 'node-type-present'"), ["corpus", "mapping_id", "node_type"], "path_authority", "mapping_id", "node_type_unproven")
    return types.unionByName(_lacks(rows, dependencies.where("kind = 'path-present'"), ["corpus", "mapping_id", "feature"], "path_authority", "mapping_id", "path_unproven"))


def value_set_authority(mappings: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Value sets of which a value isn't proven to be there; `value` joins the values of a set by |."""
    rows = mappings.where("shape = 'value-set-predicate'").withColumn("value", F.explode(F.split("value", r"\|")))
    bare = _lacks(rows, dependencies.where("kind = 'native-value-present'"), ["corpus", "mapping_id", "node_type", "feature", "value"], "value_set_authority", "mapping_id", "native_semantics_unproven")
    return bare.distinct()


def path_values_authority(steps: DataFrame, domains: DataFrame) -> DataFrame:
    """Steps (mapping_id, edge, source, target, values) whose values no single reviewed domain (edge, source, target, reviewed) covers.

    Source and target are as the edge is stored, whichever way a step walks it.
    """
    keyed = steps.withColumn("_step", F.struct("mapping_id", "edge", "source", "target"))
    covered = keyed.join(domains, ["edge", "source", "target"]).where((F.size("values") > 0) & (F.size(F.array_except("values", "reviewed")) == 0))
    return _broken(keyed.join(covered.select("_step").distinct(), "_step", "left_anti"), "path_values_authority", "mapping_id", F.lit("dependency_authority"))


def ordered_path_authority(plans: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edge paths that their own dependencies don't prove; the first reason of each counts.

    `plans` has (corpus, mapping_id, node_type, steps as executor.gathered() gives them); `dependencies` (corpus,
    mapping_id, kind, node_type, path array of (edge, direction), edge, source, target, value_type, values). Every type
    that a path meets must be among the mapping's own node types (node_type_unproven), and the whole path, in its
    order, among its paths (path_unproven). A step with values needs one domain that covers them all, between the types
    that the edge has as it is stored: a step goes on from the one before, and an incoming one is turned round.
    """
    by = ["corpus", "mapping_id"]
    walks = plans.where("shape = 'edge-path'").select(*by, "node_type", "steps")
    own = lambda kind: dependencies.where(F.col("kind") == kind)
    met = walks.select(*by, F.explode(F.array_distinct(F.concat(F.array("node_type"), F.transform("steps", lambda s: s["result_type"])))).alias("node_type"))
    unproven = met.join(own("node-type-present").select(*by, "node_type").distinct(), [*by, "node_type"], "left_anti").select(*by).distinct().withColumn("_types", F.lit(True))
    ways = lambda a: F.to_json(F.transform(a, lambda s: F.struct(s["edge"].alias("edge"), s["direction"].alias("direction"))))
    proven = own("path-present").select(*by, ways(F.col("path")).alias("_way")).distinct().withColumn("_proven", F.lit(True))
    # where a step begins: at the result of the one before, or at the start
    here = lambda i: F.when(i == 0, F.col("node_type")).otherwise(F.get(F.col("steps"), i - 1)["result_type"])
    placed = walks.select(*by, F.inline(F.transform("steps", lambda s, i: F.struct(here(i).alias("here"), s.alias("s"))))).where("s.match_values IS NOT NULL")
    out = F.col("s.direction") == "outgoing"
    asked = placed.select(
        *by, "s.step", "s.edge", F.when(out, F.col("here")).otherwise(F.col("s.result_type")).alias("source"), F.when(out, F.col("s.result_type")).otherwise(F.col("here")).alias("target"), F.col("s.match_type").alias("value_type"), "s.match_values"
    )
    domains = own("edge-value-domain").select(*by, "edge", "source", "target", "value_type", "values")
    covered = asked.join(domains, [*by, "edge", "source", "target", "value_type"]).where((F.size("match_values") > 0) & (F.size(F.array_except("match_values", "values")) == 0))
    open_steps = asked.join(covered.select(*by, "step").distinct(), [*by, "step"], "left_anti").select(*by).distinct().withColumn("_values", F.lit(True))
    joined = walks.withColumn("_way", ways(F.col("steps"))).join(unproven, by, "left").join(proven, [*by, "_way"], "left").join(open_steps, by, "left")
    problem = (
        F.when(F.size("steps") == 0, "path_empty")
        .when(F.col("_types"), "node_type_unproven")
        .when(F.col("_proven").isNull(), "path_unproven")
        .when(F.col("_values"), "dependency_authority")
    )
    return _broken(joined, "ordered_path_authority", "mapping_id", problem)


def native_semantics(mappings: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Null and empty values are selectors only where a dependency proves that they mean something."""
    rows = mappings.where("value IS NULL OR value = ''").withColumn("value", F.coalesce("value", F.lit("")))
    there = dependencies.where("kind = 'native-value-present'").withColumn("value", F.coalesce("value", F.lit("")))
    return _lacks(rows, there, ["corpus", "mapping_id", "node_type", "feature", "value"], "native_semantics", "mapping_id", "native_semantics_unproven")


def review_digests(rows: DataFrame, key: str, stored: str, computed: Column, reviewed: str) -> DataFrame:
    """Rows whose stored, computed and reviewed digests aren't one."""
    same = F.col(stored).eqNullSafe(computed) & F.col(stored).eqNullSafe(F.col(reviewed)) & F.col(stored).isNotNull()
    return _broken(rows, "review_digests", key, F.when(~same, "review_digest_mismatch"))


def target_locks(projections: DataFrame, locks: DataFrame) -> DataFrame:
    """Projections on a lock that isn't there, or to a target that its lock doesn't use."""
    known = locks.select("lock_id").distinct()
    no_lock = _lacks(projections, known, ["lock_id"], "target_locks", "projection_id", "missing_reference")
    there = projections.join(known, "lock_id", "left_semi")
    return no_lock.unionByName(_lacks(there, locks.withColumnRenamed("term", "target"), ["lock_id", "target"], "target_locks", "projection_id", "unknown_ontology_target"))


def components(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Uses (id, component_id) of components that aren't declared (component_id, required), or aren't required."""
    joined = used.join(declared.select("component_id", "required"), "component_id", "left")
    return _broken(joined, "components", "id", F.when(F.col("required").isNull(), "missing_reference").when(~F.col("required"), "component_authority"))


def bridges(rows: DataFrame, locks: DataFrame) -> DataFrame:
    """Bridges (bridge_id, source_lock, source_term, source_digest, target_…) whose ends their locks don't have as said."""
    ends = [rows.select("bridge_id", F.lit(s).alias("end"), F.col(f"{s}_lock").alias("lock_id"), F.col(f"{s}_term").alias("term"), F.col(f"{s}_digest").alias("said")) for s in ("source", "target")]
    joined = ends[0].unionByName(ends[1]).join(locks, ["lock_id", "term"], "left")
    problem = F.when(F.col("content_digest").isNull(), F.concat("end", F.lit("_missing"))).when(~F.col("said").eqNullSafe(F.col("content_digest")), F.concat("end", F.lit("_digest_mismatch")))
    return _broken(joined, "bridges", "bridge_id", problem)


def embedded_locks(embedded: DataFrame, canonical: DataFrame) -> DataFrame:
    """Embedded locks (lock_id, content_digest) that differ from the canonical ones, or that these lack."""
    joined = embedded.select("lock_id", "content_digest").distinct().join(canonical.select("lock_id", F.col("content_digest").alias("_canonical")).distinct(), "lock_id", "left")
    return _broken(joined, "embedded_locks", "lock_id", F.when(F.col("_canonical").isNull(), "missing_reference").when(~F.col("content_digest").eqNullSafe(F.col("_canonical")), "bundle_closure"))


def evidence(bindings: DataFrame, known: DataFrame) -> DataFrame:
    """Evidence (id, evidence_id, content_digest) that isn't there, or has another digest."""
    joined = bindings.join(known.select("evidence_id", F.col("content_digest").alias("_known")), "evidence_id", "left")
    return _broken(joined, "evidence", "id", F.when(F.col("_known").isNull(), "missing_reference").when(~F.col("content_digest").eqNullSafe(F.col("_known")), "evidence_digest_mismatch"))


def manifest(items: DataFrame, technical: DataFrame, gaps: DataFrame) -> DataFrame:
    """Coverage manifests, tables of (item_id, kind): ids that don't begin with their kind, come twice, or lie in two tables."""
    every = [t.select("item_id", "kind", F.lit(n).alias("table")) for n, t in enumerate((items, technical, gaps))]
    rows = functools.reduce(DataFrame.unionByName, every)
    named = _broken(rows, "manifest", "item_id", F.when(~F.startswith("item_id", F.concat("kind", F.lit(":"))), "item_identity_mismatch"))
    n, tables = F.count("*"), F.count_distinct("table")
    several = rows.groupBy("item_id").agg(F.when(tables > 1, "denominator_overlap").when(n > 1, "duplicate_id").alias("_problem"))
    return named.unionByName(_broken(several, "manifest", "item_id", F.col("_problem")))


def pipeline(stages: list[DataFrame]) -> DataFrame:
    """The problems of the first stage that has any: (stage, rule, id, problem). Later stages would only repeat them."""
    numbered = functools.reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(k)) for k, s in enumerate(stages)])
    first = numbered.agg(F.min("stage").alias("stage"))
    return numbered.join(F.broadcast(first), "stage")  # one row


def first_problem(problems: DataFrame) -> DataFrame:
    """The least problem by rule, id and name: what a report of one problem says."""
    return problems.orderBy("rule", F.encode("id", "UTF-16BE"), "problem").limit(1)
