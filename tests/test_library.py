"""Small graphs and catalogs: what SQL on the given tables can't show."""

import pytest
from pyspark.sql import functions as F

from glossgraph.functions import digests
from glossgraph.operators import accounting, census, correspondence, ordering, paths, selectors, sets
from glossgraph.operators.selectors import SelectionError
from glossgraph.plans import prerequisites, resolver
from glossgraph.plans.prerequisites import Dependency
from glossgraph.sources import catalog, feature_files, strict_json
from glossgraph.sources.graph import EdgeType, TableCorpus


@pytest.fixture(scope="module")
def graph(spark):
    words = spark.createDataFrame([(1, "subs", "pl", 1), (2, "subs", "", 2), (3, "verb", None, 1), (4, "subs", "pl", None)], "node long, sp string, nu string, freq int")
    lines = spark.createDataFrame([(10, "a"), (11, "b")], "node long, name string")
    columns = spark.createDataFrame([(20, None), (21, None)], "node long, name string")
    edges = {
        "word_line": spark.createDataFrame([(1, 11), (1, 10), (2, 10), (1, 20)], "src long, dst long"),
        "line_column": spark.createDataFrame([(11, 21), (11, 20), (10, 20)], "src long, dst long"),
        "witness": spark.createDataFrame([(10, 1, "unique"), (11, 1, ""), (11, 2, None)], "src long, dst long, value string"),
        "score": spark.createDataFrame([(10, 1, 5), (11, 2, None)], "src long, dst long, value int"),
    }
    types = {"word_line": EdgeType("word", "line"), "line_column": EdgeType("line", "column"), "witness": EdgeType("line", "word", "str"), "score": EdgeType("line", "word", "int")}
    return TableCorpus("tiny", {"word": words, "line": lines, "column": columns}, types, edges)


def ids(df):
    return sorted(r.node for r in df.collect())


def test_selectors_and_types(graph):
    words = graph.nodes("word")
    assert ids(selectors.value_predicate(words, "sp", "subs")) == [1, 2, 4]
    assert ids(selectors.value_predicate(words, "freq", 1)) == [1, 3]
    assert ids(selectors.guarded_membership(words, "nu")) == [1, 4]
    assert ids(selectors.text_value(words, "freq", "2")) == [2]
    for value in ("1", True, 1.0, None):
        with pytest.raises(SelectionError, match="value_type"):
            selectors.value_predicate(words, "freq", value)
    with pytest.raises(SelectionError, match="value_set"):
        selectors.value_set_predicate(words, "sp", ["subs", "subs"])
    with pytest.raises(SelectionError, match="feature_missing"):
        selectors.value_predicate(words, "gender", "f")


def test_paths_types_values_and_order(graph, spark):
    one = graph.nodes("word").where("node = 1")
    steps = [paths.Step("word_line", "line"), paths.Step("line_column", "column")]
    assert ids(paths.traverse(graph, one, steps)) == [20, 21]
    assert ids(paths.traverse(graph, graph.nodes("column").where("node = 21"), [paths.Step("line_column", "line", "incoming")])) == [11]
    assert ids(paths.traverse(graph, graph.nodes("line"), [paths.Step("witness", "word", match_values=("",))])) == [1]
    assert ids(paths.traverse(graph, graph.nodes("line"), [paths.Step("score", "word", match_values=(5,))])) == [1]
    assert ids(paths.traverse(graph, graph.nodes("word").where("node = 3"), steps)) == []
    kept = paths.evidence(graph, one, steps).collect()
    assert sorted((r.step, r.src, r.dst) for r in kept) == [(0, 1, 10), (0, 1, 11), (1, 10, 20), (1, 11, 20), (1, 11, 21)]
    back = paths.evidence(graph, graph.nodes("line").where("node = 10"), [paths.Step("word_line", "word", "incoming")]).collect()
    assert sorted((r.src, r.dst) for r in back) == [(1, 10), (2, 10)]
    walk = TableCorpus("w", {"x": spark.range(20).selectExpr("id AS node")}, {"e": EdgeType("x", "x")}, {"e": spark.createDataFrame([(1, 3), (1, 2), (2, 10), (3, 9)], "src long, dst long")}, {"x": (0, 19)})
    ranked = paths.discovery_order(walk, spark.createDataFrame([(1,)], "node long"), [paths.Step("e", "x"), paths.Step("e", "x")]).orderBy("ord").collect()
    assert [r.node for r in ranked] == [10, 9]
    assert paths.dangling(walk, "e").first() == (0, 4)
    for step, what in ((paths.Step("no", "line"), "edge_missing"), (paths.Step("word_line", "x"), "node_type_missing"), (paths.Step("word_line", "line", "up"), "direction"), (paths.Step("word_line", "line", match_values=("a",)), "edge_unvalued"), (paths.Step("score", "word", match_values=("5",)), "value_type"), (paths.Step("score", "word", match_values=(True,)), "value_type")):
        with pytest.raises(SelectionError, match=what):
            paths.traverse(graph, one, [step])


def test_conjunctions(graph):
    words = graph.nodes("word")
    a, b = selectors.value_predicate(words, "sp", "subs"), selectors.value_predicate(words, "nu", "pl")
    domain = ("tiny", "word")
    assert ids(sets.conjunction([(domain, a), (domain, b)])) == ids(sets.conjunction([(domain, b), (domain, a)])) == [1, 4]
    with pytest.raises(SelectionError, match="node_domain"):
        sets.conjunction([(domain, a), (("tiny", "line"), b)])
    with pytest.raises(SelectionError, match="conjunction"):
        sets.conjunction([(domain, a)])


ROWS = [
    ("c1", "1.0", "value", "exact", "urn:n", "word", "sp", "subs"),
    ("c1", None, "value", "unsupported", None, "word", "sp", "verb"),
    ("c1", "1.0", "value", "exact", "urn:v", "word", "sp", "verb"),
    ("c2", None, "value", "narrower", "urn:n", "w", "pos", "N"),
    ("c2", "2.0", "value", "close", "urn:p", "w", "pos", "P"),
    ("c2", "2.0", "value", "broader", "urn:q", "w", "pos", "Q"),
    ("c2", "2.0", "value", "broader", "urn:q", "w", "pos", "R"),
    ("tiny", None, "value", "exact", "urn:n", "word", "sp", "subs"),
    ("tiny", None, "value", "exact", "urn:pl", "word", "nu", "pl"),
    ("tiny", None, "value", "exact", "urn:two", "word", "sp", "subs"),
    ("tiny", None, "value", "exact", "urn:two", "word", "sp", "verb"),
    ("tiny", None, "node", "exact", "urn:line", "line", None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, "corpus string, corpus_version string, kind string, relation string, target string, node string, feature string, value string")
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in catalog.MAPPING))


def test_catalog_rules(rows, spark):
    found = catalog.conflicts(rows).collect()
    assert [(r.corpus, r.a, r.b) for r in found] == [("c1", "exact", "unsupported")]
    assert catalog.row_violations(rows).count() == 0
    twice = rows.where("relation = 'unsupported'").withColumn("corpus_version", F.lit("3.0"))
    assert sorted((r.a, r.b) for r in catalog.conflicts(rows.unionAll(twice)).collect()) == [("exact", "unsupported"), ("unsupported", "unsupported")]
    bad = rows.limit(1).withColumns({"target": F.lit("no scheme"), "edge": F.lit(1)})
    assert catalog.row_violations(bad).first().problem == "target_missing"
    assert catalog.row_violations(rows.limit(1).withColumn("kind", F.lit("x"))).first().problem == "kind"
    assert catalog.row_violations(rows.limit(1).withColumn("from_node", F.lit("x"))).first().problem == "selector"
    edge = rows.limit(1).withColumns({"kind": F.lit("edge"), "node": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "from_node": F.lit("a")})
    assert catalog.row_violations(edge).count() == 0 and catalog.row_violations(edge.withColumn("from_node", F.lit(" "))).first().problem == "selector"
    assert catalog.duplicates(rows.unionAll(rows.limit(1))).count() == 1


def test_lookups_and_correspondences(rows, graph):
    assert correspondence.map_native(rows, "c1", kind="value", node="word", feature="sp", value="verb", version="9").count() == 1
    with pytest.raises(SelectionError, match="version_ambiguous"):  # a row without a version and one with
        correspondence.map_native(rows, "c1", kind="value", node="word", feature="sp", value="verb")
    with pytest.raises(SelectionError, match="version_unverified"):
        correspondence.map_native(rows, "c1", kind="value", node="word", feature="sp", value="subs", version="9")
    assert correspondence.find_by_target(rows, "urn:n").count() == 2
    assert correspondence.find_by_target(rows, "urn:n", include_approximate=True).count() == 3
    pairs = correspondence.correspondences(rows, "c1", include_approximate=True).collect()
    assert {(r.b_corpus, r.relation) for r in pairs} == {("c2", "approximate-via-target"), ("tiny", "exact")}
    got = correspondence.resolve_nodes(graph, rows).collect()
    assert sorted(r.node for r in got if r.target == "urn:n") == [1, 2, 4] and sorted(r.node for r in got if r.target == "urn:line") == [10, 11]


def test_resolution_refuses_rather_than_answers_empty(rows, graph):
    plan = resolver.resolve_exact(rows, "tiny", ["urn:n", "urn:pl"])
    nodes, losses = resolver.execute_conjunction(graph, plan)
    assert ids(nodes) == [1, 4] and losses == ()
    for target, what in (("urn:none", "no_exact_binding"), ("urn:two", "multiple_exact_bindings")):
        with pytest.raises(SelectionError, match=what):
            resolver.resolve_exact(rows, "tiny", [target])
    assert resolver.resolve_approximate(rows, "c2", "urn:n", ("overcoverage",)).losses == ("overcoverage",)
    assert resolver.resolve_approximate(rows, "tiny", "urn:n", ()).losses == ()
    for target, accepted, what in (("urn:p", ("overcoverage",), "approximation_loss_not_accepted"), ("urn:q", (), "multiple_approximate_bindings"), ("urn:x", (), "semantic_tuple_absent")):
        with pytest.raises(SelectionError, match=what):
            resolver.resolve_approximate(rows, "c2", target, accepted)
    table = {(r.corpus, r.target): (r.status, r.category) for r in resolver.choose(resolver.with_losses(rows), ["overcoverage"]).collect()}
    assert table["c2", "urn:n"] == ("approximate", None) and table["c2", "urn:p"] == ("refused", "approximation_loss_not_accepted") and table["tiny", "urn:two"] == ("refused", "multiple_exact_bindings")
    start = resolver.Plan("tiny", "urn:x", "word", "sp", ("nothing",), (paths.Step("word_line", "line"),))
    with pytest.raises(SelectionError, match="empty_start"):
        resolver.execute(graph, start)


def test_prerequisites(graph):
    ask = lambda kind, **x: prerequisites.evaluate(graph, Dependency(kind, **x))
    assert ask("feature-present", node_type="word", feature="nu") == "pass"
    assert ask("feature-present", node_type="column", feature="name") == "unknown"
    assert ask("feature-present", node_type="word", feature="x") == "fail"
    assert ask("value-domain", node_type="word", feature="sp", values=("subs", "verb"), closed=True) == "pass"
    assert ask("value-domain", node_type="word", feature="sp", values=("subs",), closed=True) == "fail"
    assert ask("value-domain", node_type="word", feature="sp", values=("subs", "adj")) == "fail"
    assert ask("native-value-present", node_type="word", feature="sp", value="verb") == "pass"
    assert ask("edge-value-domain", edge="score", node_type="line", target_type="word", values=(5,)) == "pass"
    assert ask("edge-value-domain", edge="score", node_type="line", target_type="word", values=("5",)) == "fail"
    assert ask("path-present", steps=("word_line", "line_column")) == "pass" and ask("edge-present", edge="no") == "fail"
    assert ask("extent-interpretation", node_type="word", extent="noSlot") == "unknown" and ask("node-type-present", node_type="line") == "pass"
    assert prerequisites.report(["pass", "unknown", "fail"]) == "incompatible" and prerequisites.report(["unknown"]) == "unverified"
    assert prerequisites.report(["pass"], same_parent=True) == "verified-exact" and prerequisites.problem("unverified") == "prerequisite_unverified"


def test_comparison_ignores_exact_plans(spark):
    plans = spark.createDataFrame([("a", []), ("a", ["o"]), ("b", []), ("c", ["o"]), ("c", ["u", "o"]), ("d", ["o", "u"]), ("d", ["u", "o"])], "k string, losses array<string>")
    got = {r.k: r.state for r in sets.comparison_state(plans, ["k"]).collect()}
    assert got == {"a": "approximately-comparable", "b": "exactly-comparable", "c": "heterogeneous-loss", "d": "approximately-comparable"}
    assert {r.k: r.losses for r in sets.union_losses(plans, ["k"]).collect()}["c"] == ["o", "u"]


def test_census_of_empty_strings(graph):
    r = {x.feature: x for x in census.feature_census(graph, "word", ["nu", "freq"]).collect()}
    assert (r["nu"].raw, r["nu"].populated, r["nu"].empty, r["nu"].distinct) == (3, 2, 1, 1) and r["freq"].populated == 3


def test_releases_and_overlays(spark):
    new, old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string"), spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert [r.k for r in accounting.added(new, old).collect()] == [3]
    assert [r.k for r in accounting.added(new.unionAll(new), old).orderBy("k").collect()] == [1, 2, 3, 3]
    with pytest.raises(Exception, match="not_additive"):
        accounting.added(old, new).collect()
    delta = spark.createDataFrame([(2, "b"), (3, "x"), (9, "y")], "k long, v string")
    assert {r.k: r.v for r in accounting.overlay(new, delta, "k", "v").collect()} == {1: "a", 2: "b", 3: "c"}
    assert sorted(r.k for r in accounting.overlay_conflicts(new, delta, "k", "v").collect()) == [3, 9]
    assert accounting.owners(spark.createDataFrame([(1, "C"), (1, "D"), (2, "C")], "k long, owner string"), "k").count() == 1


def test_latest_then_filter(spark):
    rows = [("Ann", 1, "ok"), ("ann", 2, "revoked"), ("Bob", 1, "ok"), ("bob", 1, "ok")]
    events = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "login string, ts int, state string, id int")
    assert [r.login for r in ordering.latest(events, [F.lower("login")], "ts", "id").where("state = 'ok'").collect()] == ["bob"]
    words = spark.createDataFrame([("",), ("\U00010000",), ("z",)], "w string")
    assert [r.w for r in words.orderBy(ordering.utf16(F.col("w"))).collect()] == ["z", "\U00010000", ""]
    versions = spark.createDataFrame([("1.10",), ("1.9",), ("1.2.3",)], "v string")
    assert [r.v for r in versions.orderBy(ordering.version_key(F.col("v"))).collect()] == ["1.2.3", "1.9", "1.10"]


def test_canonical_json():
    text = digests.canonical_json
    assert text({"b": [1, 1.0, 1e21, 1e-7, 0.1, -0.0, 333333333.33333329, 1e20], "a": None, "€": "x\n", "\U0001f600": True}) == '{"a":null,"b":[1,1,1e+21,1e-7,0.1,0,333333333.3333333,100000000000000000000],"€":"x\\n","😀":true}'
    assert text({"": 1, "\U00010000": 2}).index("2") < text({"": 1, "\U00010000": 2}).index("1")
    for bad in (2**53, float("nan"), {1: 2}, "\ud800", {3}):
        with pytest.raises(digests.DigestError):
            text(bad)
    assert digests.digest({}) == "sha256:44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"


def test_strict_json():
    assert strict_json.loads(b'\xef\xbb\xbf{"a": [1, "x"]}') == {"a": [1, "x"]}
    for bad in (b'{"a": 1, "a": 2}', b"[NaN]", b"\xff", b"[" * 200 + b"]" * 200, b"{"):
        with pytest.raises(strict_json.SourceError):
            strict_json.loads(bad)


def test_feature_files(spark, tmp_path):
    (tmp_path / "otype.tf").write_text("@node\n@valueType=str\n@note=a=b\n\nword\nword\n5-7\tphrase\nclause\n20\tbook\n")
    (tmp_path / "bad.tf").write_text("@node\n@edgeValues\n\nx\n")
    numbered = feature_files.lines(spark, f"{tmp_path}/*.tf").cache()
    heads = {r.file.rsplit("/", 1)[1]: r for r in feature_files.headers(numbered).collect()}
    assert heads["otype.tf"].marker == "node" and heads["otype.tf"].entries == {"valueType": "str", "note": "a=b"} and heads["otype.tf"].problem is None
    assert heads["bad.tf"].problem == "edge_values"
    found = feature_files.ranges(numbered.where("file LIKE '%otype.tf'"))
    assert sorted((r["first"], r["last"], r.value) for r in found.collect()) == [(1, 1, "word"), (2, 2, "word"), (5, 7, "phrase"), (8, 8, "clause"), (20, 20, "book")]
    assert {r.value: r.n for r in feature_files.type_counts(found).collect()} == {"word": 2, "phrase": 3, "clause": 1, "book": 1}
    assert sorted(r.node for r in feature_files.nodes(found).collect()) == [1, 2, 5, 6, 7, 8, 20]
    assert feature_files.inventory(spark, f"{tmp_path}/*.tf").count() == 2


def test_xml_catalog(spark, tmp_path):
    (tmp_path / "c1.xml").write_text('<?xml version="1.0"?><mappings corpus="c1" source="s" corpusVersion="1.0"><map kind="value" relation="exact" target="urn:n" node="word" feature="sp" value="subs"/><map corpusVersion="2.0" kind="node" relation="exact" target="urn:w" node="word"/><map kind="edge" relation="native-only" from="a" to="b" feature="e">note</map></mappings>')
    (tmp_path / "c2.xml").write_text('<mappings corpus="c2" source="t"><map kind="node" relation="close" target="urn:n" node="w"/></mappings>')
    rows = catalog.read_xml(spark, f"{tmp_path}/*.xml")
    got = {(r.corpus, r.corpus_version, r.kind, r.relation, r.target, r.from_node) for r in rows.collect()}
    assert got == {("c1", "1.0", "value", "exact", "urn:n", None), ("c1", "2.0", "node", "exact", "urn:w", None), ("c1", "1.0", "edge", "native-only", None, "a"), ("c2", None, "node", "close", "urn:n", None)}
    assert [r.corpus for r in catalog.corpora(rows).collect()] == ["c1", "c2"] and catalog.row_violations(rows).count() == 0
    assert catalog.unknown_attributes(spark, f"{tmp_path}/*.xml").count() == 0 and catalog.misnamed(spark, f"{tmp_path}/*.xml").count() == 0
    (tmp_path / "c3.xml").write_text('<mappings corpus="other" source="t"><map kind="node" relation="close" target="urn:n" node="w" colour="red"/></mappings>')
    assert [r.attribute for r in catalog.unknown_attributes(spark, f"{tmp_path}/*.xml").collect()] == ["colour"]
    assert [r.corpus for r in catalog.misnamed(spark, f"{tmp_path}/*.xml").collect()] == ["other"] and catalog.load(spark, str(tmp_path), "c2").count() == 1


def test_item_ids(spark):
    df = spark.createDataFrame([("a=b:c", 'q"\\/~é')], "f string, v string")
    item = accounting.item_id("value", F.lit("f"), F.col("v"))
    kind, feature, value = accounting.item_parts(F.col("i"))
    r = df.withColumn("i", item).select("i", kind.alias("k"), feature.alias("f"), value.alias("v"), accounting.pointer_token(F.lit("a/b~c")).alias("p")).first()
    assert (r.k, r.f, r.v, r.p) == ("value", "f", '"q\\"\\\\/~é"', "a~1b~0c")


def test_drained_streams_lie_in_files_and_not_in_the_driver(spark):
    from glossgraph.streaming import tables

    folder = "/root/testdata/sf0.001"
    pairs = tables.event_stream(spark, folder).groupBy("event_type", "user_id").agg(F.count("*").alias("k"))
    drained = tables.drain(pairs)
    assert drained.inputFiles()
    want = spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type", "user_id").agg(F.count("*").alias("k"))
    assert sorted(map(tuple, drained.collect())) == sorted(map(tuple, want.collect()))
