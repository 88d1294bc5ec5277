import json
import re
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from glossgraph.llm import licenses
from glossgraph.llm.queries import op4_license_scan


def words_of(text):
    return re.findall("[a-z0-9]+", text.lower())


def dice(words, t):
    grams = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    return 2 * len(grams & set(t.bigrams)) / (len(grams) + len(t.bigrams)) if grams else 0


def brute(text, known, least=licenses.LEAST):
    """Every passage and every laid window against every template, without any pruning: best of each licence."""
    if not text:
        return []
    blocks = [b for b in re.split(r"\n[ \t\r]*\n", text) if "\n" in b]
    words = words_of(text)
    passages = [words_of(p) for p in [*text.split("\n"), *blocks, text]]
    best = {}
    for t in known:
        place = dict(zip(t.bigrams, t.places, strict=True))
        begins = {i - place[g] for i, g in enumerate(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)) if g in place}
        for part in [*passages, *(words[max(b, 0) : b + t.n_words] for b in begins)]:
            d = dice(part, t)
            if d >= least:
                entry = (-d, t.name, " ".join(part))
                best[t.name] = min(best.get(t.name, entry), entry)
    return [(name, -d, p) for d, name, p in sorted(best.values())]


BSD = dict(licenses.TEXTS)["BSD-3-Clause"]
MIT = dict(licenses.TEXTS)["MIT"]
TEXTS = [
    None, "", "license", "Licensed under CC BY-NC 4.0.", "licensed   UNDER the Apache license version 2 0", f"a\n\n{BSD[:70]}\n{BSD[70:300]}\n \nb",
    "x\nReleased under the MIT License\ny " + "z " * 50000, "Released under MIT", "This work is licensed under the GNU General Public License, version 2.",
    "Copyright 2020 Foo Bar. Released under the MIT License. All rights.", "some prose here released under\nthe MIT license and\nmore of it", f"before {MIT.replace('free of charge', 'gratis')} after " + "w " * 300,
    " ".join(MIT.split()[40:]), f"{MIT} {BSD} Licensed under the Apache License, Version 2.0.", "License license LICENSE " * 2000,
]


def check(found, want, key):
    assert [(x.license, x.passage) for x in found] == [(n, p) for n, _, p in want], key
    assert [x.dice for x in found] == pytest.approx([d for _, d, _ in want]), key


def test_scan_matches_unpruned_comparison(spark):
    known = licenses.templates()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, license string")
    rows = licenses.scan(df.unionAll(df)).collect()
    assert len(rows) == 2 * len(TEXTS) and all(r.license == "x" for r in rows)
    for r in rows:
        check(r.licenses, brute(TEXTS[r.doc_id], known), r.doc_id)


def test_notices_inside_longer_lines_are_found(spark):
    df = spark.createDataFrame([(k, TEXTS[k]) for k in (9, 10, 11)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        assert r.licenses[0].license == "MIT", r.doc_id


def test_query_on_the_table(spark):
    known, folder = licenses.templates(), "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op4_license_scan(spark, folder).collect()
    assert len(rows) == len(texts) and sum(r.n_matches > 0 for r in rows) > 2
    for r in rows:
        want = brute(texts[r.doc_id], known)
        assert r.n_matches == len(want) and r.licenses == ",".join(sorted(n for n, _, _ in want))
        assert (r.license, r.passage) == ((want[0][0], want[0][2]) if want else (None, None))
        assert (r.dice or 0) == pytest.approx(want[0][1] if want else 0)


def test_anchors_can_not_be_avoided():
    known = licenses.templates()
    first = set(licenses.anchor_words(known, 0.8))
    for t in known:
        left = sum(first.isdisjoint(g.split()) for g in t.bigrams)  # a passage of nothing else than these
        assert 2 * left < 0.8 * (left + len(t.bigrams))


def test_many_templates_are_one_literal(spark):
    texts = tuple((f"L{k}", f"you may use part {k} of this work {'as you wish ' * (k % 7)} under licence number {k}") for k in range(600))
    df = spark.createDataFrame([(1, "see: " + texts[417][1] + " so it is"), (None, "nothing of it")], "doc_id long, text string")
    rows = {r.doc_id: r.licenses for r in licenses.scan(df, known=licenses.templates(texts)).collect()}
    assert rows[1][0].license == "L417" and rows[1][0].dice == 1.0 and rows[None] == []


def test_no_templates_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", 5, "k")], "doc_id long, text string, licenses int, _license_low string")
    assert licenses.scan(df, known=[]).first().licenses == [] and licenses.scan(df.limit(0)).count() == 0
    row = licenses.scan(df).first()
    assert row.licenses[0].license == "MIT" and row._license_low == "k"
    assert json.dumps(licenses.templates((("x", "one"),))) == "[]" and licenses.scan(df.select(F.col("text").alias("body")), "body").count() == 1


def test_size_bounds_are_those_of_whole_numbers():
    """No size that can reach the threshold is left out, and none that can't is let in."""
    for least in (0.8, 0.7, 0.85, 2 / 3):
        t = Fraction(str(least))
        for b in range(1, 400):
            low, high = licenses.Template("x", b + 1, tuple(map(str, range(b))), tuple(range(b))).bounds(least)
            reach = [a for a in range(1, 4 * b + 4) if Fraction(2 * min(a, b), a + b) >= t]
            assert (low, high) == (reach[0], reach[-1]), (least, b)


def test_matches_at_the_threshold_count(spark):
    texts = ["licensed under the bsd zero", "some file\nlicensed under the BSD zero\n(2020)", "licensed under the bsd"]
    rows = licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    found = {r.text: [(x.license, x.dice) for x in r.licenses if x.license == "0BSD"] for r in rows}
    assert found == {texts[0]: [("0BSD", 0.8)], texts[1]: [("0BSD", 0.8)], texts[2]: []}


def test_long_licence_files_take_linear_work(spark):
    whole = licenses.TEXTS[1][1]

    def seconds(n):
        began = time.perf_counter()
        found = licenses.scan(spark.createDataFrame([((whole + " ") * n,)], "text string")).first().licenses
        assert [x.license for x in found][0] == "MIT" and found[0].dice == 1.0
        return time.perf_counter() - began

    seconds(2)
    assert seconds(320) < 8 * seconds(80) + 5  # 16 times as long would be the square
