import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from glossgraph.llm import simhash, toxicity
from glossgraph.llm.queries import op9_toxicity


def test_held_out_labels_are_predicted(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("grade", toxicity.given_grade())
    half = toxicity.F.pmod(toxicity.F.xxhash64("doc_id", toxicity.F.lit(7)), toxicity.F.lit(2))
    model = toxicity.fit(docs, labels.where(half == 0))
    rows = toxicity.score(docs.join(labels.where(half == 1), "doc_id"), model).select("toxic", F.col("grade").alias("given"), "toxicity.*").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in bad) >= 0.75 * len(bad) and sum(r.rejected for r in good) <= 0.02 * len(good)
    assert np.mean([r.severity for r in bad]) > 4 * np.mean([r.severity for r in good])
    # every threshold tells grades apart: severity rises with the grade, and most documents of bad quality are graded so
    by_grade = [np.mean([r.severity for r in rows if r.given == g]) for g in range(3)]
    assert by_grade[1] > by_grade[0] + 0.4 and by_grade[2] > by_grade[1] + 0.4
    of_bad_quality = [r.grade for r in rows if r.given == 1]
    assert of_bad_quality.count(1) >= 0.6 * len(of_bad_quality) and sum(r.grade > 0 for r in rows if r.given == 0) <= 0.05 * len(rows)
    assert all(0 <= r.severity <= 2 and r.rejected == (r.p_toxic >= toxicity.CUT) for r in rows)


def test_cumulative_link_recovers_order():
    rng = random.Random(4)
    rows, grades = [], []
    for _ in range(3000):
        found = [k for k in range(3) if rng.random() < 0.3]
        score = 3 * (0 in found) + 1.5 * (1 in found) + math.log(1 / rng.uniform(1e-6, 1 - 1e-6) - 1)
        rows.append(found)
        grades.append(0 if score < 1 else 1 if score < 3 else 2)
    weights, thresholds = toxicity.fit_cumulative_link(rows, np.array(grades), 3)
    assert abs(weights[0] - 3) < 0.4 and abs(weights[1] - 1.5) < 0.3 and abs(weights[2]) < 0.3
    assert abs(thresholds[0] - 1) < 0.3 and abs(thresholds[1] - 3) < 0.4


def test_features_are_of_the_whole_text():
    assert b"clown" in toxicity.features("x " * 100000 + "CLOWN!!") and b"clow*" in toxicity.features("clowns")
    assert toxicity.features("a !!! b") >= {b" !"} and b" ALONE" in toxicity.features("a | b") and b" ALONE" not in toxicity.features("a|b")
    assert {b" CAPITALS", b" AGAIN"} <= toxicity.features("SOME LOUD WORDS! again again") and not {b" CAPITALS", b" AGAIN"} & toxicity.features("Some LOUD words again")
    assert toxicity.features(None) == toxicity.features(" ,;") == set()


def test_nulls_one_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([None, "", "idiot here", "fine words", "idiot here"])], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(2, 2), (3, None), (4, 2), (None, 0)], "doc_id long, grade int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and not any(r.toxicity.rejected for r in rows) and rows[0].severity == "x"
    many = spark.createDataFrame([(k, f"you idiot {k}" if k % 3 == 0 else f"good day {k}") for k in range(90)], "doc_id long, text string")
    model = toxicity.fit(many, many.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) * 2 AS grade"))
    rows = toxicity.score(docs, model).collect()
    assert [r.toxicity.rejected for r in rows] == [False, False, True, False, True]
    assert toxicity.score(docs.limit(0), model).count() == 0


def objective(rows, grades, weights, thresholds, ridge=1.0):
    """Penalised log likelihood by plain loops; gaps between thresholds are penalised on their logarithm."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    total = 0.0
    for found, g in zip(rows, grades, strict=True):
        s = sum(weights[k] for k in found)
        upper = 1.0 if g == len(thresholds) else sigmoid(thresholds[g] - s)
        lower = 0.0 if g == 0 else sigmoid(thresholds[g - 1] - s)
        total += math.log(max(upper - lower, 1e-12))
    gaps = [math.log(b - a) for a, b in zip(thresholds, thresholds[1:], strict=False)]
    return total - ridge / 2 * sum(w * w for w in weights) - 0.05 * sum(g * g for g in gaps)


def test_fit_can_not_be_bettered_by_a_plain_search():
    rng = random.Random(8)
    rows = [[k for k in range(4) if rng.random() < 0.4] for _ in range(300)]
    grades = np.array([min(2, int(sum(rows[i]) / 2 + rng.random())) for i in range(300)])
    weights, thresholds = toxicity.fit_cumulative_link(rows, grades, 4)
    best, at = objective(rows, grades, weights, thresholds), [*weights, *thresholds]
    for k in range(len(at)):
        for step in (-0.3, -0.05, 0.05, 0.3):
            moved = list(at)
            moved[k] += step
            if moved[4] < moved[5]:
                assert objective(rows, grades, moved[:4], moved[4:]) < best + 0.02, (k, step)


def test_query_scores_as_plain_loops_do(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("grade", toxicity.given_grade())
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    # the telling features, counted plainly
    rows = [r for r in labels.collect() if r.doc_id in docs]
    ids, graded = [r.doc_id for r in rows], [(r.grade, r.toxic, docs[r.doc_id]) for r in rows]
    assert all((g == toxicity.TOXIC) == (t > 0) for g, t, _ in graded)
    counts, seen = {}, {}
    for doc_id, (grade, toxic, text) in zip(ids, graded, strict=True):
        least = min(simhash.shingle_hashes(text, 5), default=0)
        seen.setdefault((least, grade), []).append((doc_id, toxic, text))
    hashed = {r.doc_id: r.h for r in spark.range(max(docs) + 1).selectExpr("id AS doc_id", "xxhash64(id) AS h").collect()}
    kept = [min(x, key=lambda r: (hashed[r[0]], r[0])) for x in seen.values()]
    grade_of, want = dict(zip(ids, (g for g, _, _ in graded), strict=True)), set()
    for doc_id, _, text in kept:
        for f in toxicity.features(text):
            counts.setdefault(f, Counter())[grade_of[doc_id]] += 1
    for f, c in counts.items():
        for k in (1, 2):  # each threshold between grades
            b, n = sum(c[g] for g in c if g >= k), c.total()
            share, g = sum(grade_of[i] >= k for i, _, _ in kept) / len(kept), n - b
            if b > n * share and 2 * (b * math.log(b / (n * share)) + (g * math.log(g / (n * (1 - share))) if g else 0)) >= toxicity.LEAST_GAIN:
                want.add(f)
    assert set(model.weights) == want
    rows = op9_toxicity(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = sum(model.weights[f] for f in toxicity.features(docs[r.doc_id]) if f in model.weights)
        worded = sum(model.weights[f] for f in toxicity.features(docs[r.doc_id]) if f in model.weights and not f.startswith(b" "))
        toxic = 0.0 if math.isinf(model.thresholds[1]) else 1 / (1 + math.exp(model.thresholds[1] - worded))
        above = [0.0 if math.isinf(t) else 1 / (1 + math.exp(t - s)) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert abs(r.severity - sum(above)) < 1e-9 and abs(r.p_toxic - toxic) < 1e-9 and abs(each[r.grade] - max(each)) < 1e-9
        assert r.toxic == (toxic >= toxicity.CUT)


def test_repeated_rows_long_texts_and_a_clashing_column(spark):
    many = spark.createDataFrame([(k, f"you idiot {k}" if k % 3 == 0 else f"good day {k}") for k in range(90)], "doc_id long, text string")
    model = toxicity.fit(many.unionAll(many), many.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) * 2 AS grade"))
    df = spark.createDataFrame([(1, "day " * 100000 + "idiot", 3), (1, "day", 3), (1, "day", 3), (None, None, 3)], "doc_id long, text string, toxicity int")
    rows = toxicity.score(df, model).collect()
    assert sorted(r.toxicity.rejected for r in rows) == [False, False, False, True]
