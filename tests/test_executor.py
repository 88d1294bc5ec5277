"""Plans of all shapes executed together, and requests over named corpora, on small cases."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from glossgraph import bundle_queries
from glossgraph.operators import accounting
from glossgraph.plans import bindings, executor
from glossgraph.registry import ORACLES
from glossgraph.sources.graph import EdgeType, TableCorpus


@pytest.fixture(scope="module")
def corpus(spark):
    word = spark.createDataFrame([(1, "verb", 2), (2, "noun", 2), (3, None, 5), (4, "verb", None)], "node long, sp string, freq int")
    line = spark.createDataFrame([(10, "a"), (11, "b")], "node long, label string")
    edges = {
        "holds": spark.createDataFrame([(10, 1), (10, 2), (11, 3), (11, 4)], "src long, dst long"),
        "near": spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (2, 3, ""), (4, 3, None), (3, 10, "x")], "src long, dst long, value string"),
    }
    return TableCorpus("tiny", {"word": word, "line": line, "void": word.limit(0)}, {"holds": EdgeType("line", "word"), "near": EdgeType("word", "word", "str")}, edges)


#: (plan, shape, node type, feature, values as (type, value), steps as (edge, direction, result type, values))
PLANS = [
    ("all", "membership", "word", None, [], []),
    ("again", "membership", "word", None, [], []),
    ("verbs", "value-predicate", "word", "sp", [("str", "verb")], []),
    ("twos", "value-predicate", "word", "freq", [("int", "2")], []),
    ("set", "value-set-predicate", "word", "sp", [("str", "noun"), ("str", "verb")], []),
    ("nothing", "value-predicate", "word", "sp", [("str", "adverb")], []),
    ("down", "edge-path", "line", None, [], [("holds", "outgoing", "word", None)]),
    ("far", "edge-path", "line", None, [], [("holds", "outgoing", "word", None), ("near", "outgoing", "word", ["x", "y"])]),
    ("empty text", "edge-path", "line", None, [], [("holds", "outgoing", "word", None), ("near", "outgoing", "word", [""])]),
    ("up", "edge-path", "word", None, [], [("near", "incoming", "word", None), ("holds", "incoming", "line", None)]),
    ("end", "edge-path", "word", None, [], [("near", "outgoing", "word", ["z"]), ("near", "outgoing", "word", None)]),
    ("void", "edge-path", "void", None, [], [("near", "outgoing", "word", None)]),
]
BAD = [
    ("shape", "closure", "word", None, [], [], "unsupported_native_binding"),
    ("type", "membership", "clause", None, [], [], "node_type_missing"),
    ("feature", "value-predicate", "word", "case", [("str", "x")], [], "feature_missing"),
    ("two", "value-predicate", "word", "sp", [("str", "a"), ("str", "b")], [], "value_set"),
    ("twice", "value-set-predicate", "word", "sp", [("str", "a"), ("str", "a")], [], "value_set"),
    ("text", "value-predicate", "word", "freq", [("str", "2")], [], "value_type"),
    ("null", "value-predicate", "word", "sp", [("str", None)], [], "value_type"),
    ("no steps", "edge-path", "word", None, [], [], "path_empty"),
    ("edge", "edge-path", "word", None, [], [("gone", "outgoing", "word", None)], "edge_missing"),
    ("result", "edge-path", "word", None, [], [("near", "outgoing", "word", None), ("near", "outgoing", "clause", None)], "node_type_missing"),
    ("way", "edge-path", "word", None, [], [("near", "both", "word", None)], "direction"),
    ("unvalued", "edge-path", "line", None, [], [("holds", "outgoing", "word", ["x"])], "edge_unvalued"),
    ("match twice", "edge-path", "word", None, [], [("near", "outgoing", "word", ["x", "x"])], "value_set"),
]


def gathered(spark, plans, match_type="str"):
    selectors = spark.createDataFrame([("tiny", p[0], *p[1:4]) for p in plans], "corpus string, plan_id string, shape string, node_type string, feature string")
    values = spark.createDataFrame([("tiny", p[0], v, t) for p in plans for t, v in p[4]], "corpus string, plan_id string, value string, value_type string")
    kind = "corpus string, plan_id string, step int, edge string, direction string, result_type string, match_values array<string>, match_type string"
    steps = spark.createDataFrame([("tiny", p[0], k, *s, match_type) for p in plans for k, s in enumerate(p[5])], kind)
    return executor.gathered(selectors, values, steps)


def test_plans_of_all_shapes(spark, corpus):
    done = executor.execute(spark, {"tiny": corpus}, gathered(spark, [*PLANS, *(b[:6] for b in BAD)]))
    plans = {r.plan_id: r for r in done.plans.collect()}
    assert {k: plans[k].problem for k in plans} == {**{p[0]: None for p in PLANS}, **{b[0]: b[6] for b in BAD}, "void": "invalid_result_nodes"}
    assert all((r.problem is None) != (r.answer is None) for r in plans.values())
    nodes = {}
    for r in done.nodes.collect():
        nodes.setdefault(r.answer, []).append(r.node)
    got = {k: sorted(nodes.get(plans[k].answer, [])) for k in plans if plans[k].problem is None}
    assert got == {"all": [1, 2, 3, 4], "again": [1, 2, 3, 4], "verbs": [1, 4], "twos": [1, 2], "set": [1, 2, 4], "nothing": [], "down": [1, 2, 3, 4], "far": [2, 3], "empty text": [3], "up": [10, 11], "end": []}
    assert plans["all"].answer == plans["again"].answer


def test_evidence_is_as_stored_and_beginnings_are_walked_once(spark, corpus):
    done = executor.execute(spark, {"tiny": corpus}, gathered(spark, PLANS))
    plans = {r.plan_id: r.answer for r in done.plans.collect()}
    paths = {(r.answer, r.step): r.path for r in done.paths.collect()}
    assert paths[plans["far"], 0] == paths[plans["down"], 0] == paths[plans["empty text"], 0]
    layer = lambda plan, k: sorted((r.src, r.dst, r.value_present, r.value) for r in done.evidence.where(f"path = '{paths[plans[plan], k]}'").collect())
    assert layer("far", 1) == [(1, 2, True, "x"), (1, 3, True, "y")]
    assert layer("up", 0) == [(1, 2, True, "x"), (1, 3, True, "y"), (2, 3, True, ""), (4, 3, False, None)]
    assert layer("up", 1) == [(10, 1, False, None), (10, 2, False, None), (11, 4, False, None)]
    assert len(layer("down", 0)) == 4


def test_no_plans_unknown_corpora_and_wrong_types_of_edge_values(spark, corpus):
    done = executor.execute(spark, {"tiny": corpus}, gathered(spark, []))
    assert done.plans.count() == done.nodes.count() == done.evidence.count() == 0
    done = executor.execute(spark, {"other": corpus}, gathered(spark, PLANS[:1]))
    assert [r.problem for r in done.plans.collect()] == ["missing_execution_component"]
    done = executor.execute(spark, {"tiny": corpus}, gathered(spark, PLANS[7:8], "int"))
    assert [r.problem for r in done.plans.collect()] == ["value_type"]


KEY = ("p", "p.c", None, "class", "role")


def key(n):
    return ("p", "p.c", f"t{n}", "class", "role")


@pytest.fixture(scope="module")
def resolved(spark):
    rows = [("A", *key(1), "exact", None, "a1", []), ("A", *key(2), "approximate", None, "a2", ["undercoverage"]), ("B", *key(1), "refused", "multiple_exact_bindings", None, []), ("B", *key(2), "refused", "non_substitutive_mapping", None, [])]
    kind = "corpus string, " + ", ".join(f"{k} string" for k in bindings.SEMANTIC_KEY) + ", status string, category string, projection_id string, losses array<string>"
    return spark.createDataFrame(rows, kind)


def ask(spark, resolved, requests, corpora, **more):
    asked = spark.createDataFrame([(r, *key(n)) for r, n in requests], "request int, " + ", ".join(f"{k} string" for k in bindings.SEMANTIC_KEY))
    return bindings.asked(resolved, asked, spark.createDataFrame(corpora, "request int, corpus string"), **more)


def test_a_corpus_that_refuses_all_keys_stays_and_forbids_aggregates(spark, resolved):
    rows = ask(spark, resolved, [(1, 1), (1, 2)], [(1, "A"), (1, "B"), (1, "B")])
    plans = bindings.conjunctions(rows)
    assert sorted((r.corpus, r.status, r.category, tuple(r.losses)) for r in plans.collect()) == [("A", "approximate", None, ("undercoverage",)), ("B", "refused", "multiple_exact_bindings", ())]
    assert [(r.state, r.aggregate_allowed) for r in bindings.comparison(plans, ["request"], opt_in=True).collect()] == [("partial/non-executable", False)]


def test_absent_keys_and_corpora_are_refused_rows(spark, resolved):
    rows = ask(spark, resolved, [(1, 1), (1, 3), (2, 1)], [(1, "A"), (1, "C"), (2, "A")])
    got = {(r.request, r.corpus, r.target): (r.status, r.category, r.projection_id) for r in rows.collect()}
    absent = ("refused", "semantic_tuple_absent", None)
    assert got == {(1, "A", "t1"): ("exact", None, "a1"), (1, "A", "t3"): absent, (1, "C", "t1"): absent, (1, "C", "t3"): absent, (2, "A", "t1"): ("exact", None, "a1")}
    assert {(r.request, r.corpus): r.category for r in bindings.conjunctions(rows).collect()} == {(1, "A"): "semantic_tuple_absent", (1, "C"): "semantic_tuple_absent", (2, "A"): "invalid_semantic_conjunction"}


def test_order_of_reasons(spark, resolved):
    gated = spark.createDataFrame([("A", None), ("B", "parent_unverified"), ("C", None), ("D", None)], "corpus string, category string")
    capable = spark.createDataFrame([("A", "p", "p.c", "active"), ("B", "p", "p.c", "active"), ("C", "p", "p.c", "unavailable")], "corpus string, profile string, capability string, state string")
    rows = ask(spark, resolved, [(1, 1)], [(1, c) for c in "ABCDE"], gated=gated, capable=capable)
    assert {r.corpus: r.category for r in rows.collect()} == {"A": None, "B": "parent_unverified", "C": "capability_unavailable", "D": "capability_absent", "E": "missing_prerequisite"}


def test_absent_values_differ_from_null_ones(spark):
    rows = spark.createDataFrame([(1, True, "v"), (2, True, None), (3, False, None), (4, False, "v"), (5, None, "v")], "k int, value_present boolean, value string")
    assert {r.k: (r.state, r.value) for r in bindings.native(rows).collect()} == {1: ("given", "v"), 2: ("null", None), 3: ("absent", None), 4: ("absent", None), 5: ("absent", None)}


def test_authority_of_ordered_paths(spark):
    from glossgraph.operators import violations

    ab = [("near", "outgoing", "word", None), ("holds", "incoming", "line", ["x", "y"])]
    plans = gathered(spark, [(n, "edge-path", "word", None, [], ab) for n in ("good", "type", "order", "ends", "cover", "kind", "other")] + [("one", "edge-path", "word", None, [], ab[:1]), ("none", "edge-path", "word", None, [], [])])
    rows = []
    for n in ("good", "type", "order", "ends", "cover", "kind", "one"):
        rows += [(n, "node-type-present", t, None, None, None, None, None, None) for t in (("word",) if n in ("type", "one") else ("word", "line"))]
        way = [(e, d) for e, d, *_ in ab]
        rows.append((n, "path-present", None, way[::-1] if n == "order" else way[: 1 if n == "one" else 2], None, None, None, None, None))
        # the second step walks against its edge, so the edge runs from its result to the first step's result
        source, target = ("word", "line") if n == "ends" else ("line", "word")
        for values in (["x"], ["y"]) if n == "cover" else (["x", "y", "z"],):
            rows.append((n, "edge-value-domain", None, None, "holds", source, target, "int" if n == "kind" else "str", values))
    kind = "corpus string, mapping_id string, kind string, node_type string, path array<struct<edge:string,direction:string>>, edge string, source string, target string, value_type string, values array<string>"
    needs = spark.createDataFrame([("tiny", *r) for r in rows], kind)
    found = violations.ordered_path_authority(plans.withColumnRenamed("plan_id", "mapping_id"), needs)
    assert {r.id: r.problem for r in found.collect()} == {"none": "path_empty", "type": "node_type_unproven", "other": "node_type_unproven", "order": "path_unproven", "ends": "dependency_authority", "cover": "dependency_authority", "kind": "dependency_authority"}


def test_batches_of_keys_meet_a_built_index_where_it_lies(spark):
    rows = spark.createDataFrame([(f"k{n % 50}", "entity-identity", True, "a", "s", f"r{n}") for n in range(200)], "external string, reference_kind string, reviewed boolean, authority_system string, identity_strength string, reference_id string")
    built = bindings.build_index(rows, "identity", bindings.IDENTITY_KEY)
    keys = spark.createDataFrame([("a", "k1", "s"), ("a", "k2", "s"), ("a", "k2", "s"), ("a", "gone", "s")], "authority_system string, external string, identity_strength string")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        met = bindings.look_up(keys, built, bindings.IDENTITY_KEY)
        plan = met._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("FileScan") :]
        assert "Bucketed: true" in scan and plan.count("Exchange hashpartitioning") == 1  # of the keys alone
        got = sorted((r.external, r.reference_id or "") for r in met.collect())
    finally:
        spark.conf.set(setting, before)
    assert got == sorted([("gone", ""), *((f"k{n % 50}", f"r{n}") for n in range(200) if n % 50 in (1, 2))])


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The smallest tables with the keys of orders so large that sums over a few nodes pass 64 bits, and DuckDB over them."""
    folder = tmp_path_factory.mktemp("far")
    duck = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
        rows = f"SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'"
        if t in ("orders", "lineitem"):
            key = f"{t[0]}_orderkey"
            rows = f"SELECT * REPLACE ({key} + 4000000000000000000 AS {key}) FROM ({rows})"
        duck.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return str(folder), duck


def uncast(sql, *columns):
    """SQL without the casts of sums that these keys pass."""
    for c in columns:
        assert f"CAST(sum({c}) AS BIGINT)" in sql
        sql = sql.replace(f"CAST(sum({c}) AS BIGINT)", f"sum({c})")
    return sql


def test_evidence_of_any_size_is_summed_up(spark, far):
    folder, duck = far
    found = bundle_queries.execution_evidence(spark, folder)
    kinds = dict(found.dtypes)
    assert (kinds["src_sum"], kinds["dst_sum"]) == ("decimal(38,0)", "bigint")  # a column that has room stays as it was
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({uncast(ORACLES['execution_evidence'], 'src', 'dst')})").fetchall()
    assert max(r[2] for r in want) > 2**63
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_nodes_of_bindings_of_any_size_are_summed_up(spark, far):
    folder, duck = far
    found = bundle_queries.execute_bindings(spark, folder)
    assert dict(found.dtypes)["node_sum"] == "decimal(38,0)"
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({uncast(ORACLES['execute_bindings'], 'node')})").fetchall()
    assert max(r[-1] or 0 for r in want) > 2**63
    assert sorted(map(repr, (tuple(int(x) if isinstance(x, Decimal) else x for x in r) for r in found.collect()))) == sorted(map(repr, want))


def test_sums_are_exact_at_any_size(spark):
    top = 2**63 - 1
    rows = spark.createDataFrame([("a", top, 1, -top), ("a", 0, 2, -1), ("b", -5, None, -top), ("b", 5, None, 7)], "k string, x long, y int, z long")
    sums = accounting.exact_sums(rows, ["k"], {"sx": "x", "sy": "y", "sz": "z"}, F.count("*").alias("n"))
    assert sums.dtypes == [("k", "string"), ("sx", "bigint"), ("sy", "bigint"), ("sz", "bigint"), ("n", "bigint")]
    assert {tuple(r) for r in sums.collect()} == {("a", top, 3, -top - 1, 2), ("b", 0, None, 7 - top, 2)}
    wide = accounting.exact_sums(rows.union(rows.where("y = 1")), ["k"], {"sx": "x", "sy": "y"})
    assert wide.dtypes == [("k", "string"), ("sx", "decimal(38,0)"), ("sy", "bigint")]
    assert {(r.k, int(r.sx), r.sy) for r in wide.collect()} == {("a", 2 * top, 4), ("b", 0, None)}
    assert accounting.exact_sums(rows.limit(0), ["k"], {"sx": "x"}).dtypes == [("k", "string"), ("sx", "bigint")]
