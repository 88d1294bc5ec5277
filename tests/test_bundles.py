"""Corpora from files, bindings, rules and digests on small cases that the given tables don't have."""

import bz2
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from glossgraph.functions import digests
from glossgraph.operators import changes, paths, sets
from glossgraph.operators import violations as rules
from glossgraph.operators.selectors import SelectionError
from glossgraph.plans import bindings
from glossgraph.sources import corpus_files, feature_files


def test_corpus_from_feature_files(spark, tmp_path):
    (tmp_path / "otype.tf").write_text("@node\n@valueType=str\n\nword\nword\nword\n4-5\tline\n")
    (tmp_path / "sp.tf").write_text("@node\n@valueType=str\n\nsubs\n3\tverb\n")
    (tmp_path / "freq.tf").write_text("@node\n@valueType=int\n\n1-3\t7\n5\t9\n")
    (tmp_path / "oslots.tf").write_text("@edge\n@valueType=str\n\n4\t1-2\n5\t3\n")
    (tmp_path / "score.tf").write_text("@edge\n@edgeValues\n@valueType=int\n\n1\t4,5\t3\n2\t5\t\n")
    corpus = corpus_files.load(spark, str(tmp_path), "tiny")
    assert corpus.node_types() == ["line", "word"] and corpus.edge_names() == ["oslots", "score"]
    assert sorted(tuple(r) for r in corpus.nodes("word").select("node", "sp", "freq").collect()) == [(1, "subs", 7), (2, None, 7), (3, "verb", 7)]
    assert sorted(tuple(r) for r in corpus.nodes("line").select("node", "freq").collect()) == [(4, None), (5, 9)]
    assert sorted(tuple(r) for r in corpus.edges("oslots").collect()) == [(4, 1), (4, 2), (5, 3)]
    assert sorted(tuple(r) for r in corpus.edges("score").collect()) == [(1, 4, 3), (1, 5, 3), (2, 5, None)]
    found = paths.traverse(corpus, corpus.nodes("word").where("sp = 'subs'"), [paths.Step("score", "line", match_values=(3,)), paths.Step("oslots", "word")])
    assert sorted(r.node for r in found.collect()) == [1, 2, 3]
    said = [(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir() if p.name != "sp.tf"]
    manifest = spark.createDataFrame([("freq.tf", 1, "x") if s[0] == "freq.tf" else s for s in said] + [("gone.tf", 1, "x")], "file string, bytes long, sha256 string")
    assert {r.file: r.state for r in corpus_files.reconciled(spark, str(tmp_path), manifest).collect()} == {"sp.tf": "undeclared", "freq.tf": "changed", "gone.tf": "missing"}
    (tmp_path / "otype.tf").rename(tmp_path / "otype.txt")
    with pytest.raises(SelectionError, match="otype_missing"):
        corpus_files.load(spark, str(tmp_path), "tiny")


def test_headers_without_one_kind(spark):
    texts = [("a", "@nod\n@x=1\n\n1\tv"), ("b", "@node\n@edge\n\n1\tv"), ("c", "@node\n@edgeValues\n\n1\tv"), ("d", "\ufeff@edge\r\n@edgeValues\r\n\r\n1\t2\t3")]
    numbered = feature_files.text_lines(spark.createDataFrame(texts, "file string, text string"), "file", "text")
    found = {r.file: (r.marker, r.problem) for r in feature_files.headers(numbered).collect()}
    assert found == {"a": (None, "marker"), "b": (None, "marker"), "c": ("node", "edge_values"), "d": ("edge", None)}


def test_documents_bundles_and_releases(spark, tmp_path):
    item = lambda i, p: {"item_id": i, "kind": "value", "accounting": {"research": None, "production": p}}
    layer = {"assessments": ["exact"], "common_target": True, "source_ids": ["s"]}
    (tmp_path / "m.json").write_text(json.dumps({"corpus_id": "c", "semantic_items": [item("value:a", layer), item("value:b", None)]}))
    rows = {r.item_id: r for r in corpus_files.manifests(spark, str(tmp_path)).collect()}
    assert rows["value:a"].production.assessments == ["exact"] and rows["value:b"].production is None and rows["value:a"].research is None
    profiles = spark.createDataFrame([("c", "1", ["x", "y"]), ("c", "2", ["y"])], "corpus_id string, profile_version string, mapping_sources array<string>")
    sources = spark.createDataFrame([("x", "m1"), ("y", "m2"), ("z", "m3")], "source string, mapping_id string")
    mapped = corpus_files.profile_mappings(profiles, sources)
    one = corpus_files.bundle({"profiles": profiles, "mappings": mapped}, "c", "1")
    assert sorted(r.mapping_id for r in one["mappings"].collect()) == ["m1", "m2"]
    with pytest.raises(SelectionError, match="bundle_missing"):
        corpus_files.bundle({"profiles": profiles}, "c", "3")
    catalogue = spark.createDataFrame([("c", "1", False), ("c", "2", True), ("d", "1", True), ("d", "2", True)], "corpus_id string, release_id string, current boolean")
    wanted = spark.createDataFrame([("c", "current"), ("c", "1"), ("c", "9"), ("d", "current"), ("e", "1")], "corpus_id string, wanted string")
    got = {(r.corpus_id, r.wanted): (r.release_id, r.problem) for r in corpus_files.releases(catalogue, wanted).collect()}
    assert got == {("c", "current"): ("2", None), ("c", "1"): ("1", None), ("c", "9"): (None, "release_missing"), ("d", "current"): (None, "release_ambiguous"), ("e", "1"): (None, "release_missing")}


def test_pinned_files_codes_and_ontologies(spark, tmp_path):
    raw = bz2.compress(b"OBJECT TYPE\nword\n")
    (tmp_path / "a.bz2").write_bytes(raw)
    blob = hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()
    pins = spark.createDataFrame([("a.bz2", len(raw), blob), ("b.bz2", 1, "x")], "file string, bytes long, blob string")
    assert {r.file: r.problem for r in corpus_files.pinned(spark, str(tmp_path), pins).collect()} == {"a.bz2": None, "b.bz2": "missing"}
    assert [r.value for r in spark.read.text(f"{tmp_path}/a.bz2").collect()] == ["OBJECT TYPE", "word"]
    texts = spark.createDataFrame([("g", "x = 1\n# nouns\nsubs = noun\nnone\n# verbs\nverb = verb")], "doc string, text string")
    found = corpus_files.codes(corpus_files.numbered_lines(texts, "doc", "text"), "doc", "^# (.+)$", "^([a-z]+) = (.+)$").collect()
    assert [(r.line_number, r.section, r.code, r.gloss) for r in found] == [(3, "nouns", "subs", "noun"), (6, "verbs", "verb", "verb")]
    (tmp_path / "o.owl").write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="urn:a"><rdfs:subClassOf rdf:resource="urn:b"/><rdfs:subClassOf rdf:resource="urn:c"/></owl:Class><owl:Class rdf:about="urn:b"/></rdf:RDF>')
    got = {(r.iri, r.parent) for r in corpus_files.ontology_classes(spark, f"{tmp_path}/o.owl").collect()}
    assert got == {("urn:a", "urn:b"), ("urn:a", "urn:c"), ("urn:b", None)}


def test_order_of_refusals(spark):
    rows = [("t1", "exact", True, []), ("t1", "close", True, ["u"]), ("t2", "related", True, []), ("t3", "close", False, ["u"]), ("t4", "close", True, ["u"]), ("t4", "broader", True, ["v"]), ("t5", "broader", True, ["v"]), ("t6", "broader", True, ["u"]), ("t6", "close", False, ["v"]), ("t7", "exact", True, []), ("t7", "exact", True, [])]
    df = spark.createDataFrame([("c", t, a, e, x, f"p{k}") for k, (t, a, e, x) in enumerate(rows)], "corpus string, target string, assessment string, eligible boolean, losses array<string>, projection_id string")
    got = {r.target: (r.status, r.category, r.losses) for r in bindings.resolve(df, ("target",), ("u",)).collect()}
    assert got == {
        "t1": ("exact", None, []), "t2": ("refused", "non_substitutive_mapping", []), "t3": ("refused", "approximation_not_authorized", []), "t4": ("refused", "multiple_approximate_bindings", []),
        "t5": ("refused", "approximation_loss_not_accepted", []), "t6": ("approximate", None, ["u"]), "t7": ("refused", "multiple_exact_bindings", []),
    }
    assert {r.category for r in bindings.resolve(df.where("target = 't5'"), ("target",), None).collect()} == {"no_exact_binding"}
    plans = spark.createDataFrame([("a", "exact", []), ("b", "approximate", ["u"]), ("b", "exact", []), ("c", "approximate", ["u"]), ("c", "approximate", ["v"]), ("d", "refused", [])], "k string, status string, losses array<string>")
    allowed = {r.k: (r.state, r.aggregate_allowed) for r in bindings.comparison(plans, ["k"], True).collect()}
    assert allowed == {"a": ("exactly-comparable", True), "b": ("approximately-comparable", True), "c": ("heterogeneous-loss", False), "d": ("partial/non-executable", False)}


def test_rules_and_changes(spark):
    none = spark.createDataFrame([(None, "m")], "value string, mapping_id string").selectExpr("'c' AS corpus", "mapping_id", "'w' AS node_type", "'f' AS feature", "value")
    needs = spark.createDataFrame([("c", "m", "native-value-present", "w", "f", "")], "corpus string, mapping_id string, kind string, node_type string, feature string, value string")
    assert rules.native_semantics(none, needs).count() == 0 and rules.native_semantics(none, needs.limit(0)).count() == 1
    digest = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", None, None)], "id string, stored string, reviewed string")
    assert sorted(r.id for r in rules.review_digests(digest, "id", "stored", F.lit("x"), "reviewed").collect()) == ["b", "c"]
    used = spark.createDataFrame([("u", "a"), ("v", "b"), ("w", "z")], "id string, component_id string")
    declared = spark.createDataFrame([("a", True), ("b", False)], "component_id string, required boolean")
    assert {r.id: r.problem for r in rules.components(used, declared).collect()} == {"v": "component_authority", "w": "missing_reference"}
    locks = spark.createDataFrame([("l", "d"), ("m", "e")], "lock_id string, content_digest string")
    assert {r.id: r.problem for r in rules.embedded_locks(locks.replace("e", "f").unionAll(spark.createDataFrame([("n", "x")], locks.schema)), locks).collect()} == {"m": "bundle_closure", "n": "missing_reference"}
    words = spark.createDataFrame([("class",)], "formal_kind string")
    kinds = spark.createDataFrame([("p", "class"), ("q", "klass")], "id string, formal_kind string")
    assert [r.id for r in rules.unknown_words(kinds, words, "formal_kind", "id").collect()] == ["q"] and rules.repeated_ids(kinds.unionAll(kinds), ["id"], "id").count() == 2
    active = spark.createDataFrame([("a", "native-only"), ("b", "positive"), ("c", "ambiguous")], "mapping_id string, native_state string")
    moves = spark.createDataFrame([("a", "a2", "urn:x"), ("b", "b2", "urn:y")], "mapping_id string, new_id string, target string")
    assert {r.mapping_id: r.action for r in changes.supersede(active, moves).collect()} == {"a": "retired", "a2": "added", "b": "refused", "c": "kept"}
    reviews = spark.createDataFrame([("i", "Ann", "accept", 1, 1), ("i", "ann", "reject", 2, 2), ("i", "bob", "accept", 1, 3), ("j", "ann", "accept", 1, 4), ("j", "bob", "accept", 2, 5), ("j", "cy", "pending", 3, 6)], "item string, who string, state string, ts int, id int")
    assert {r["item"]: r.status for r in changes.decided(reviews, "item", F.col("who")).collect()} == {"i": "disputed", "j": "accept"}
    a, t = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2)], "k string, n int"), spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 3)], "k string, n int")
    assert {r.k: r.state for r in sets.inclusion(a, t, ["k"], "n").collect()} == {"x": "undercoverage", "y": "overcoverage", "z": "undercoverage"}


def test_digests_of_meaning(spark, tmp_path):
    mapping = {"mapping_id": "m", "profiles": ["b", "a"], "review": {"x": 1}, "rationale": "r", "projections": [{"projection_id": "p", "review": 1, "rationale": "kept"}, {"projection_id": "o"}], "steps": ["b", "a"]}
    turned = {**mapping, "profiles": ["a", "b"], "projections": mapping["projections"][::-1], "rationale": "other"}
    assert digests.mapping_digest(mapping) == digests.mapping_digest(turned) != digests.mapping_digest({**mapping, "steps": ["a", "b"]})
    assert digests.semantic_content(mapping, dropped=digests.AUDIT_TOP)["projections"][1] == {"projection_id": "p", "rationale": "kept"}
    record = {"evidence_id": "e", "kind": "k", "source_uri": "u", "reviewed_content": {"a": 1}, "content_mode": "normalized-record", "citation": "c"}
    assert digests.evidence_digest(record) == digests.evidence_digest({**record, "citation": "d"}) != digests.evidence_digest({**record, "license_ref": "l"})
    part = lambda i, **x: {"component_id": i, "kind": "k", "identity_algorithm": "a", "content_digest": "d", **x}
    assert digests.parent_manifest_digest({"components": [part("b"), part("a", license_ref="l")]}) == digests.parent_manifest_digest({"components": [part("a"), part("b")]})
    with pytest.raises(digests.DigestError):
        digests.parent_manifest_digest({"components": [part("a"), part("a")]})
    profile = {"profile_id": "p", "mappings": [{"mapping_id": "b"}, {"mapping_id": "a"}], "semantic_domains": ["y", "x"]}
    assert digests.profile_digest(profile) == digests.profile_digest({**profile, "mappings": profile["mappings"][::-1]})
    assert digests.fingerprint("a/1", x=1) != digests.fingerprint("a/2", x=1)
    values = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "b"]), (3, ["a"])], "k int, v array<string>").select("k", digests.binding_identity(F.lit("w"), F.lit("f"), F.col("v")).alias("d"))
    got = {r.k: r.d for r in values.collect()}
    assert got[1] == got[2] == digests.digest({"node_type": "w", "feature": "f", "values": ["a", "b"]}) != got[3]
    rows = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (1, 2, 3)], "step int, src long, dst long")
    same = digests.evidence_set(rows.repartition(3), ["step"]).collect()
    assert {r.step: r.n for r in same} == {0: 2, 1: 1} and {(r.step, r.digest) for r in same} == {(r.step, r.digest) for r in digests.evidence_set(rows.orderBy(F.desc("dst")), ["step"]).collect()}
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    from glossgraph.sources.feature_files import inventory

    files = [{"file_sha256": "sha256:" + hashlib.sha256(t.encode()).hexdigest(), "logical_path": n} for n, t in (("a", "x"), ("b", "y"))]
    assert digests.payload_digest(inventory(spark, f"{tmp_path}/*")).first().digest == digests.digest(files)


def test_canonical_order_of_results(spark):
    df = spark.createDataFrame([("b", 2), ("b", None), (None, 1), ("\U00010000", 1), ("￮", 1), ("b", 10)], "k string, n int")
    assert [tuple(r) for r in bindings.ordered(df, "k", "n").collect()] == [(None, 1), ("b", None), ("b", 2), ("b", 10), ("\U00010000", 1), ("￮", 1)]
    assert [r.n for r in bindings.first_of(df.where("k = 'b' AND n IS NOT NULL"), ["k"], ["n"]).collect()] == [2]
