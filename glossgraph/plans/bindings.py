"""Bindings as tables: what bundles compile to, and how keys resolve against them, for all corpora and keys at once.

A binding is a reviewed projection of a reviewed mapping. Keys that aren't resolved have a category that says why;
the order in which reasons are asked for is part of the contract. Nothing is collected: resolution is grouping.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossgraph.session import shared_folder

#: The vocabulary of bindings.
ASSESSMENTS = ("exact", "close", "broader", "narrower", "related")
SUBSTITUTES = ("close", "broader", "narrower")
SEMANTIC_KEY = ("profile", "capability", "target", "formal_kind", "semantic_role")
AUTHORITY_KEY = ("lock_id", "target", "formal_kind", "semantic_role")
IDENTITY_KEY = ("authority_system", "external", "identity_strength")
IDENTIFIER_KEY = ("issuer", "external")
NATIVE_KEY = ("node_type", "feature", "value", "shape")
#: Reference kind and query role that a target may have.
TARGET_ROUTING = (("semantic-pivot", "semantic-constraint"), ("authority-value", "authority-value-filter"))
SAME = "same-entity"
PARENT_STATES = ("verified-exact", "verified-compatible", "unverified", "incompatible")


def compiled(mappings: DataFrame, projections: DataFrame) -> DataFrame:
    """Bindings: reviewed projections with the native selector of their reviewed mapping; losses become an array."""
    native = mappings.where("reviewed").select("corpus", "mapping_id", *NATIVE_KEY, "native_state")
    losses = F.array_sort(F.filter(F.split("losses", r"\+"), lambda x: x != ""))
    return projections.where("reviewed").drop("reviewed").withColumn("losses", losses).join(native, ["corpus", "mapping_id"])


def native(mappings: DataFrame) -> DataFrame:
    """Selectors with `state`: absent if they have no value at all, null if they have one that is null, else given.

    `value_present` says whether a selector has a value; what stands in `value` without it doesn't count.
    """
    there = F.coalesce(F.col("value_present"), F.lit(False))
    state = F.when(~there, "absent").when(F.col("value").isNull(), "null").otherwise("given")
    return mappings.withColumns({"value": F.when(there, F.col("value")), "state": state, "value_present": there})


def context_problems(contexts: DataFrame, corpus: str = "corpus") -> DataFrame:
    """(corpus, problem) of loaded components (corpus, variant, component_id): one variant a corpus, each component once."""
    n, variants, distinct = F.count("*"), F.count_distinct("variant"), F.count_distinct("component_id")
    found = contexts.groupBy(corpus).agg(F.when(variants > 1, "several_variants").when(n > distinct, "duplicate_component").alias("problem"))
    return found.where("problem IS NOT NULL")


def compile_problems(variants: DataFrame) -> DataFrame:
    """(corpus, release, category): variants that come twice, and releases of several signatures."""
    by = variants.groupBy("corpus", "release").agg(F.count("*").alias("n"), F.count_distinct("fingerprint", "parent_digest", F.coalesce("bundle_digest", F.lit(""))).alias("signatures"))
    category = F.when(F.col("signatures") > 1, "profile_release_conflict").when(F.col("n") > 1, "duplicate_bundle_variant")
    return by.select("corpus", "release", category.alias("category")).where("category IS NOT NULL")


def index(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one of the five indexes: native, semantic, authority, identity or identifier.

    A key's rows are those that are equal in the key's columns, so a lookup is a filter or a join; rows without
    review, and those that are routed elsewhere, are in none.
    """
    routed = lambda k: (F.col("reference_kind") == TARGET_ROUTING[k][0]) & (F.col("query_role") == TARGET_ROUTING[k][1])
    if kind == "semantic":
        return rows.where(routed(0))
    if kind == "authority":
        return rows.where(routed(1))
    if kind == "identity":
        return rows.where(F.col("reviewed") & (F.col("reference_kind") == "entity-identity") & F.col("authority_system").isNotNull())
    if kind == "identifier":
        return rows.where(F.col("reviewed") & (F.col("reference_kind") == "catalogue-identifier") & F.col("issuer").isNotNull())
    return rows.where("reviewed")


def index_sizes(rows: DataFrame, kind: str, key: tuple[str, ...]) -> DataFrame:
    """(index, keys, entries, most): keys, rows, and rows of the fullest key."""
    sizes = index(rows, kind).groupBy(*key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.max("n").alias("most")).select(F.lit(kind).alias("index"), "keys", "entries", "most")


def build_index(rows: DataFrame, kind: str, key: tuple[str, ...], buckets: int | None = None) -> DataFrame:
    """One of the five indexes as a table that is bucketed and sorted by its key, in the shared folder.

    A batch of keys that is joined with it meets its rows where they lie: the index isn't shuffled again, and its
    buckets are merged as they are sorted. There are as many buckets as shuffles have partitions, or more where `buckets`
    says so, about one for each 128 MB; with fewer Spark would shuffle both sides.
    """
    spark = rows.sparkSession
    buckets = max(buckets or 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"index_{kind}_{uuid.uuid4().hex}"
    index(rows, kind).write.bucketBy(buckets, *key).sortBy(*key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def look_up(keys: DataFrame, built: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows of a built index for a batch of keys; a key that isn't there comes back once, with nulls."""
    return keys.select(*key).distinct().join(built.withColumn("found", F.lit(True)), list(key), "left")


def facts(mappings: DataFrame, projections: DataFrame) -> DataFrame:
    """Capability facts by (corpus, profile, capability): native support by state, and projections by assessment.

    Only capabilities that their profile scopes count. The ids of mappings are given as their number, the least and
    the greatest, as a capability may have any number of them.
    """
    by = ["corpus", "profile", "capability"]
    scoped = F.startswith(F.col("capability"), F.concat("profile", F.lit(".")))
    one = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    state, seen = F.col("native_state"), F.col("reviewed")
    native = mappings.where(scoped).groupBy(*by).agg(
        one(seen & (state != "unsupported")).alias("reviewed_native_support"),
        *(one(seen & (state == s)).alias(s.replace("-", "_")) for s in ("ambiguous", "native-only", "unsupported")),
        one(seen).alias("mappings"),
        F.min(F.when(seen, F.col("mapping_id"))).alias("first_mapping"),
        F.max(F.when(seen, F.col("mapping_id"))).alias("last_mapping"),
    )
    bound = projections.where("reviewed").join(mappings.where("reviewed").select("corpus", "mapping_id"), ["corpus", "mapping_id"], "left_semi")
    shared = bound.groupBy(*by).agg(F.count("*").alias("shared_projections"), *(one(F.col("assessment") == a).alias(a) for a in ASSESSMENTS))
    return native.join(shared, by, "left").na.fill(0, ["shared_projections", *ASSESSMENTS])


def selected_states(states: DataFrame, variants: DataFrame) -> DataFrame:
    """For each corpus of `variants` its one fresh state, or why there is none: (corpus, category, …).

    A state is fresh if its release is compiled and its fingerprint is the release's. Without a fresh one the
    category is stale_prerequisite if there is a state at all, else missing_prerequisite; several are ambiguous.
    """
    known = variants.withColumnsRenamed({c: f"_{c}" for c in variants.columns if c not in ("corpus", "release")})
    fresh = F.col("_fingerprint").eqNullSafe(F.col("fingerprint")) & F.col("_fingerprint").isNotNull()
    judged = states.join(known, ["corpus", "release"], "left").withColumn("fresh", fresh)
    whole = F.struct(*(F.col(c) for c in judged.columns if c not in ("corpus", "fresh")))
    n = F.sum(F.col("fresh").cast("int"))
    picked = judged.groupBy("corpus").agg(n.alias("n"), F.max(F.when(F.col("fresh"), whole)).alias("state"))
    all_of = variants.select("corpus").distinct().join(picked, "corpus", "left")
    category = F.when(F.col("n").isNull(), "missing_prerequisite").when(F.col("n") == 0, "stale_prerequisite").when(F.col("n") > 1, "ambiguous_prerequisite_variant")
    return all_of.select("corpus", category.alias("category"), F.when(F.col("n") == 1, F.col("state")).alias("state"))


def bundle_gate(required: Column, state: Column, active: Column) -> Column:
    """Why the ontology bundle's state refuses execution; null if it doesn't."""
    none_needed = F.when((state != "not-required") | active.isNotNull(), "invalid_prerequisite")
    needed = (
        F.when(state == "unavailable", "ontology_bundle_unavailable")
        .when((state != "verified") | state.isNull() | (F.coalesce(active, F.lit("")) == ""), "invalid_prerequisite")
        .when(active != required, "stale_prerequisite")
    )
    return F.when(required.isNull(), none_needed).otherwise(needed)


def prerequisite_problem(s: Column) -> Column:
    """The first reason why a state isn't executable, in the contract's order; null if it is."""
    exact, compatible = s["parent_state"] == "verified-exact", s["parent_state"] == "verified-compatible"
    same = s["observed_parent_digest"].eqNullSafe(s["_parent_digest"])
    return (
        F.when(~F.coalesce(s["parent_state"].isin(*PARENT_STATES), F.lit(False)), "invalid_prerequisite")
        .when(s["parent_state"] == "unverified", "parent_unverified")
        .when(s["parent_state"] == "incompatible", "parent_incompatible")
        .when(exact & ~same, "stale_prerequisite")
        .when(compatible & same, "invalid_prerequisite")
        .when(compatible & (s["_parent_compatibility"] != "dependency-verified"), "parent_incompatible")
        .when(~s["dependencies_complete"], "stale_prerequisite")
        .when(~s["dependencies_pass"], "dependency_unavailable")
        .otherwise(bundle_gate(s["_bundle_digest"], s["bundle_state"], s["active_bundle_digest"]))
    )


def gates(states: DataFrame, variants: DataFrame) -> DataFrame:
    """(corpus, category): why a corpus isn't executable; null if it is."""
    chosen = selected_states(states, variants)
    return chosen.select("corpus", F.when(F.col("category").isNotNull(), F.col("category")).otherwise(prerequisite_problem(F.col("state"))).alias("category"))


def capabilities(found: DataFrame, gated: DataFrame) -> DataFrame:
    """Facts with their state: absent without native support, active if the corpus is executable, else unavailable."""
    joined = found.join(gated.withColumnRenamed("category", "problem"), "corpus", "left")
    state = F.when(F.col("reviewed_native_support") == 0, "absent").when(F.col("problem").isNull(), "active").otherwise("unavailable")
    return joined.withColumn("state", state).withColumn("executable_exact", (F.col("state") == "active") & (F.col("exact") > 0)).drop("problem")


def resolve(bindings: DataFrame, key: tuple[str, ...] = SEMANTIC_KEY, accepted: tuple[str, ...] | None = None) -> DataFrame:
    """(corpus, key…, status, category, projection_id, losses): what each key resolves to in each corpus that has it.

    Just one exact binding wins, several are refused. Without one, and with losses accepted (an empty tuple accepts
    none; None asks for exact ones alone): there must be close, broader or narrower bindings, just one of them
    eligible, and all its losses accepted. Related ones never stand in.
    """
    exact, substitute = F.col("assessment") == "exact", F.col("assessment").isin(*SUBSTITUTES)
    fit = substitute & F.col("eligible")
    count = lambda c: F.sum(c.cast("int"))
    pick = lambda c: F.min(F.when(c, F.struct("projection_id", "losses")))
    g = bindings.groupBy("corpus", *key).agg(
        count(exact).alias("e"), count(substitute).alias("s"), count(fit).alias("f"), count(F.col("assessment") == "related").alias("r"), pick(exact).alias("exact"), pick(fit).alias("fit")
    )
    e, s, f = F.col("e"), F.col("s"), F.col("f")
    if accepted is None:
        category = F.when(e > 1, "multiple_exact_bindings").when(e == 0, "no_exact_binding")
    else:
        lost = F.size(F.array_except("fit.losses", F.array(*map(F.lit, accepted)).cast("array<string>"))) > 0
        inexact = (
            F.when((s == 0) & (F.col("r") > 0), "non_substitutive_mapping")
            .when((s == 0) | (f == 0), "approximation_not_authorized")
            .when(f > 1, "multiple_approximate_bindings")
            .when(lost, "approximation_loss_not_accepted")
        )
        category = F.when(e > 1, "multiple_exact_bindings").when(e == 0, inexact)
    status = F.when(F.col("category").isNotNull(), "refused").when(e == 1, "exact").otherwise("approximate")
    g = g.withColumn("category", category).withColumn("status", status)
    chosen = F.when(F.col("status") == "exact", F.col("exact")).when(F.col("status") == "approximate", F.col("fit"))
    none = F.array().cast("array<string>")
    return g.withColumn("chosen", chosen).select("corpus", *key, "status", "category", "chosen.projection_id", F.when(F.col("status") == "approximate", F.col("chosen.losses")).otherwise(none).alias("losses"))


def refuse_gated(resolved: DataFrame, gated: DataFrame) -> DataFrame:
    """Resolved keys of corpora that aren't executable are refused for that reason, before any other."""
    joined = resolved.join(gated.withColumnRenamed("category", "problem"), "corpus", "left")
    shut = F.col("problem").isNotNull()
    return joined.withColumns(
        {
            "category": F.coalesce("problem", "category"),
            "status": F.when(shut, "refused").otherwise(F.col("status")),
            "projection_id": F.when(~shut, F.col("projection_id")),
            "losses": F.when(shut, F.array().cast("array<string>")).otherwise(F.col("losses")),
        }
    ).drop("problem")


def asked(resolved: DataFrame, requests: DataFrame, corpora: DataFrame, gated: DataFrame | None = None, capable: DataFrame | None = None, key: tuple[str, ...] = SEMANTIC_KEY) -> DataFrame:
    """(request, corpus, key…, status, category, projection_id, losses): each key of each request in each corpus that it names.

    `requests` has (request, key…), `corpora` (request, corpus), `resolved` what resolve() gives. A refusal is a row, not
    an absence. The first reason counts, in the contract's order: with `gated` (corpus, category) the corpus isn't known
    (missing_prerequisite) or isn't executable; with `capable` (corpus, profile, capability, state) the capability is
    absent or unavailable; the corpus has no binding of the key (semantic_tuple_absent); and then what resolve() says.
    """
    rows = requests.select("request", *key).distinct().join(corpora.select("request", "corpus").distinct(), "request")
    joined = rows.join(resolved, ["corpus", *key], "left")
    reason = F.when(F.col("status").isNull(), "semantic_tuple_absent").otherwise(F.col("category"))
    if capable is not None:
        joined = joined.join(capable.select("corpus", "profile", "capability", F.col("state").alias("_state")), ["corpus", "profile", "capability"], "left")
        state = F.coalesce("_state", F.lit("absent"))
        reason = F.when(state == "absent", "capability_absent").when(state != "active", "capability_unavailable").otherwise(reason)
    if gated is not None:
        joined = joined.join(gated.select("corpus", F.col("category").alias("_problem"), F.lit(True).alias("_known")), "corpus", "left")
        reason = F.when(F.col("_known").isNull(), "missing_prerequisite").when(F.col("_problem").isNotNull(), F.col("_problem")).otherwise(reason)
    refused = F.col("_reason").isNotNull()
    return joined.withColumn("_reason", reason).select(
        "request",
        "corpus",
        *key,
        F.when(refused, "refused").otherwise(F.col("status")).alias("status"),
        F.col("_reason").alias("category"),
        F.when(~refused, F.col("projection_id")).alias("projection_id"),
        F.when(refused, F.array().cast("array<string>")).otherwise(F.col("losses")).alias("losses"),
    )


def conjunctions(answers: DataFrame, key: tuple[str, ...] = SEMANTIC_KEY) -> DataFrame:
    """(request, corpus, status, category, losses) of what asked() gives: all keys must resolve in a corpus.

    A refused key refuses the corpus, for the reason of the first such key; fewer than two distinct keys are no
    conjunction. The losses are the union of the keys'. Each corpus that a request names has a row.
    """
    refused = F.col("status") == "refused"
    met = answers.groupBy("request", "corpus").agg(
        F.count("*").alias("n"),
        F.min(F.when(refused, F.struct(*key, "category"))).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("losses")))).alias("losses"),
    )
    category = F.when(F.col("n") < 2, "invalid_semantic_conjunction").otherwise(F.col("first.category"))
    status = F.when(F.col("category").isNotNull(), "refused").when(F.size("losses") > 0, "approximate").otherwise("exact")
    losses = F.when(F.col("category").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("losses"))
    return met.withColumn("category", category).select("request", "corpus", status.alias("status"), "category", losses.alias("losses"))


def comparison(plans: DataFrame, by: list[str], opt_in: bool = False) -> DataFrame:
    """(by, state, aggregate_allowed) of plans with status and losses.

    Any refused plan makes a comparison partial. Aggregates over corpora are allowed if all plans are exact, or if all
    that lose anything lose the same and the caller opts in.
    """
    shapes = F.count_distinct(F.when(F.size("losses") > 0, F.array_join(F.array_sort("losses"), "+")))
    refused = F.max((F.col("status") == "refused").cast("int")) == 1
    state = F.when(refused, "partial/non-executable").when(shapes == 0, "exactly-comparable").when(shapes == 1, "approximately-comparable").otherwise("heterogeneous-loss")
    found = plans.groupBy(*by).agg(state.alias("state"))
    allowed = (F.col("state") == "exactly-comparable") | (F.lit(opt_in) & (F.col("state") == "approximately-comparable"))
    return found.withColumn("aggregate_allowed", allowed)


def resolve_references(refs: DataFrame, kind: str) -> DataFrame:
    """(corpus, key…, status, reference_id): identities of one entity, or identifiers of one issuer; just one may be there.

    Of identities only those of the same entity are executable.
    """
    key = IDENTITY_KEY[:2] if kind == "identity" else IDENTIFIER_KEY
    fits = (F.col("identity_strength") == SAME) if kind == "identity" else F.lit(True)
    n = F.sum(fits.cast("int"))
    status = F.when(n == 1, "resolved").when(n == 0, "no_executable_reference").otherwise("multiple_references")
    found = index(refs, kind).groupBy("corpus", *key).agg(status.alias("status"), F.min(F.when(fits, F.col("reference_id"))).alias("only"))
    return found.select("corpus", *key, "status", F.when(F.col("status") == "resolved", F.col("only")).alias("reference_id"))


def reference_policy(kind: Column, strength: Column, native: Column, executable: Column) -> tuple[Column, Column, Column]:
    """Status, query role and reason of an external reference: which of six kinds may filter a corpus."""
    role = (
        F.when(kind == "entity-identity", "identity-filter")
        .when(kind == "catalogue-identifier", "identifier-filter")
        .when(kind == "provenance-source", "metadata/explanation")
        .when(kind == "locator", "explanation-only")
        .otherwise("none")
    )
    filters = kind.isin("entity-identity", "catalogue-identifier")
    reason = (
        F.when(role == "none", "reference kind must be explicit and controlled")
        .when(~filters, F.when(kind == "locator", "locator reference").otherwise("source/provenance reference"))
        .when((kind == "entity-identity") & (strength != SAME), strength)
        .when(native.isNull(), F.when(kind == "entity-identity", "no reviewed native identity selector").otherwise("identifier not queryable in native corpus"))
        .when(~executable, "upstream execution prerequisites are not executable")
    )
    status = F.when(role == "none", "invalid").when(reason.isNull(), "resolvable").otherwise("informative-only")
    return status, role, reason


def atom_policy(mode: str, accepted: tuple[str, ...], executable: Column) -> Column:
    """Status of one binding by itself (assessment, eligible, losses): executable-exact, executable-approximate or informative-only."""
    fits = F.col("assessment").isin(*SUBSTITUTES) & F.col("eligible") & (F.size("losses") > 0)
    fits = fits & (F.size(F.array_except("losses", F.array(*map(F.lit, accepted)).cast("array<string>"))) == 0)
    return F.when(~executable, "informative-only").when((F.col("assessment") == "exact") & (F.size("losses") == 0), "executable-exact").when(F.lit(mode == "approximate") & fits, "executable-approximate").otherwise("informative-only")


def best_candidates(bindings: DataFrame, targets: DataFrame) -> DataFrame:
    """(corpus, strength): corpora that have a binding for each of the targets, with the strengths of the best ones.

    The best binding of a target is that of the lowest rank of assessment; strengths that differ are a conjunction's.
    """
    rank = F.array_position(F.array(*map(F.lit, ASSESSMENTS)), F.col("assessment"))
    wanted = targets.select("target").distinct()
    best = bindings.join(wanted, "target", "left_semi").groupBy("corpus", "target").agg(F.min_by("assessment", F.struct(rank, "projection_id")).alias("assessment"))
    found = best.groupBy("corpus").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("assessment")).alias("strengths"))
    strength = F.when(F.size("strengths") == 1, F.get("strengths", F.lit(0))).otherwise(F.concat(F.lit("conjunction:"), F.array_join("strengths", "+")))
    return found.join(F.broadcast(wanted.agg(F.count("*").alias("wanted"))), F.col("n") == F.col("wanted")).select("corpus", strength.alias("strength"))


def execute(resolved: DataFrame, bindings: DataFrame, nodes: DataFrame, node_type: str, feature: str) -> DataFrame:
    """(corpus, target, status, losses, node): nodes of all resolved value predicates over one feature, by one join.

    `nodes` has (node, value). Bindings of other shapes, types and features aren't executed here.
    """
    chosen = bindings.where((F.col("node_type") == node_type) & (F.col("feature") == feature)).select("corpus", "projection_id", "value")
    plans = resolved.where("status <> 'refused'").select("corpus", "target", "status", "losses", "projection_id").join(chosen, ["corpus", "projection_id"])
    return plans.join(nodes, "value").select("corpus", "target", "status", "losses", "node")


def ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in the contract's order: by UTF-16, nulls first, whole numbers as numbers."""
    kind = dict(rows.dtypes)
    return rows.orderBy(*(F.encode(F.col(c), "UTF-16BE").asc_nulls_first() if kind[c] == "string" else F.col(c).asc_nulls_first() for c in columns))


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; for small keys."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")
