"""Digests of columns of documents and of ordered rows, places without gathering, and dependencies evaluated together."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from glossgraph.functions import digests
from glossgraph.operators import ordering
from glossgraph.plans import prerequisites
from glossgraph.plans.prerequisites import Dependency
from glossgraph.sources.graph import EdgeType, TableCorpus


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind > 3:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {rng.choice(["b", "a", "\U00010000", "ﬀ", "values", "review", "profiles"]): random_value(rng, depth + 1) for _ in range(4)}
    return [rng.choice(["x", "é", "\n", ""]), rng.randrange(-99, 99), rng.random() * 10 ** rng.randrange(-9, 22), rng.choice([None, True, False])][kind]


def test_columns_of_documents_are_digested_as_single_ones(spark):
    rng = random.Random(6)
    docs = [{"mapping_id": str(k), "content": random_value(rng), "rationale": random_value(rng)} for k in range(150)]
    df = spark.createDataFrame([(k, json.dumps(d, ensure_ascii=rng.random() < 0.5)) for k, d in enumerate(docs)], "k int, doc string")
    for kind in ("mapping", "projection", "json"):
        got = {r.k: r.d for r in df.select("k", digests.document_digest(F.col("doc"), kind).alias("d")).collect()}
        assert all(got[k].digest == digests.KINDS[kind](d) and got[k].problem is None for k, d in enumerate(docs))


def test_documents_that_have_no_digest(spark):
    texts = [None, "", "{", '{"a":1,"a":1}', '{"a":NaN}', '{"a":9007199254740993}', "[1]", '{"components":[]}', '"\\ud800"', '{"components":[{"component_id":"a","kind":"k","identity_algorithm":"i","content_digest":"d","more":1}]}']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", digests.document_digest(F.col("t"), "manifest").alias("d")).orderBy("k").collect()
    assert [r.d.problem for r in rows] == [None, "not_json", "not_json", "not_json", "not_json", *["not_manifest"] * 4, None]
    assert [r.d.digest is not None for r in rows] == [False] * 9 + [True]


def folded(leaves, fanout):
    while True:
        leaves = ["sha256:" + hashlib.sha256(",".join(leaves[i : i + fanout]).encode()).hexdigest() for i in range(0, len(leaves), fanout)]
        if len(leaves) == 1:
            return leaves[0]


def test_digests_of_ordered_rows(spark):
    rows = [(p, k, k * 7 % 5) for p, n in (("a", 1), ("b", 3), ("c", 4), ("d", 50)) for k in range(n)]
    df = spark.createDataFrame(rows, "plan string, ord long, node long")

    def roots(df):
        return {r.plan: (r.n, r.root) for r in digests.ordered_digest(df, ["plan"], ["ord"], 3).collect()}

    want = {}
    for p in "abcd":
        leaves = [digests.digest({"ord": k, "node": n}) for q, k, n in rows if q == p]
        want[p] = (len(leaves), folded(leaves, 3))
    assert roots(df) == roots(df.repartition(7)) == roots(df.orderBy(F.desc("ord"))) == want
    turned = df.withColumn("ord", F.when((F.col("plan") == "d") & F.col("ord").isin(20, 21), 41 - F.col("ord")).otherwise(F.col("ord")))
    assert {p for p, x in roots(turned).items() if x != want[p]} == {"d"}
    assert roots(df.limit(0)) == {}


def test_digests_of_walks_bind_all_their_parts(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    parts = {
        "plans": frame([(1, "f", "b"), (2, "f", "b")], "plan int, fingerprint string, binding string"),
        "starts": frame([(p, k, k) for p in (1, 2) for k in range(4)], "plan int, ord int, node long"),
        "layers": frame([(p, s, k, k, k + 1, True, "v") for p in (1, 2) for s in (0, 1) for k in range(5)], "plan int, step int, ord int, src long, dst long, value_present boolean, value string"),
        "finals": frame([(p, k, k) for p in (1, 2) for k in range(3)], "plan int, ord int, node long"),
    }
    get = lambda **more: {r.plan: r.digest for r in digests.walk_digest(**{**parts, **more}, fanout=2).collect()}
    same = get()
    assert same[1] == same[2] == get(layers=parts["layers"].repartition(5))[1]
    one = lambda df, c, value: df.withColumn(c, F.when(F.col("plan") == 1, value).otherwise(F.col(c)))
    changes = [
        {"plans": one(parts["plans"], "fingerprint", F.lit("g"))},
        {"plans": one(parts["plans"], "binding", F.lit("c"))},
        {"starts": one(parts["starts"], "ord", 3 - F.col("ord"))},
        {"layers": one(parts["layers"], "step", 1 - F.col("step")).where("plan <> 1 OR step = 1 OR ord < 4")},
        {"layers": one(parts["layers"], "value", F.lit("w"))},
        {"layers": parts["layers"].where("plan <> 1")},
        {"finals": one(parts["finals"], "ord", 2 - F.col("ord"))},
    ]
    for more in changes:
        got = get(**more)
        assert got[2] == same[2] and got[1] != same[1], more


def test_places_of_a_hot_key(spark):
    rows = [("hot", k // 3) for k in range(300)] + [("a", 5), ("b", 1), ("b", 1)]
    got = sorted(tuple(r) for r in ordering.places(spark.createDataFrame(rows, "k string, o int").repartition(6), ["k"], ["o"]).collect())
    assert got == [("a", 5, 0), ("b", 1, 0), ("b", 1, 1), *(("hot", k // 3, k) for k in range(300))]


def test_dependencies_together_are_those_one_by_one(spark):
    word = spark.createDataFrame([(1, "verb", 2, None), (2, "noun", 2, None), (3, None, 5, None)], "node long, sp string, freq int, empty string")
    near = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (3, 1, None)], "src long, dst long, value string")
    corpus = TableCorpus("tiny", {"word": word, "void": word.limit(0)}, {"near": EdgeType("word", "word", "str"), "plain": EdgeType("word", "word")}, {"near": near, "plain": near.drop("value")})
    needs = [Dependency("node-type-present", t) for t in ("word", "void", "gone")] + [Dependency("feature-present", t, f) for t, f in (("word", "sp"), ("word", "empty"), ("word", "gone"), ("void", "sp"), ("gone", "sp"))]
    needs += [Dependency("native-value-present", "word", "sp", value=v) for v in ("verb", "adverb")] + [Dependency("native-value-present", "word", "freq", value=v) for v in (2, 3)]
    needs += [Dependency("value-domain", "word", "sp", values=v, closed=c) for v in (("verb",), ("verb", "noun"), ("verb", "noun", "x")) for c in (False, True)]
    needs += [Dependency("edge-present", edge=e, direction=d) for e in ("near", "gone") for d in ("incoming", "both")] + [Dependency("path-present", steps=s) for s in (("near", "plain"), ("near", "gone"), ())]
    needs += [Dependency("edge-value-domain", "word", edge=e, values=v, target_type="word") for e in ("near", "plain", "gone") for v in (("x", "y"), ("x",))] + [Dependency("odd")]
    text = lambda x: None if x is None else str(x)
    kind = lambda n: "int" if isinstance(n.value, int) else "str"
    rows = [("tiny", str(k), n.kind, n.node_type, n.feature, n.edge, n.direction, kind(n), [text(v) for v in n.values] or ([text(n.value)] if n.value is not None else []), n.closed, n.target_type, list(n.steps)) for k, n in enumerate(needs)]
    schema = "corpus string, dependency_id string, kind string, node_type string, feature string, edge string, direction string, value_type string, values array<string>, closed boolean, target_type string, steps array<string>"
    got = {int(r.dependency_id): r.result for r in prerequisites.evaluate_all(spark, {"tiny": corpus}, spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: prerequisites.evaluate(corpus, n) for k, n in enumerate(needs)}
    assert prerequisites.evaluate_all(spark, {"tiny": corpus}, spark.createDataFrame([], schema)).count() == 0
