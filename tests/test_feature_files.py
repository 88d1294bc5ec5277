"""Feature files in ranges of bytes, lines that lack their node, lists, escapes and what can't be read."""

import random

import pytest

from glossgraph.operators.selectors import SelectionError
from glossgraph.sources import corpus_files, feature_files


def numbered(spark, text, chunk=feature_files.CHUNK):
    return feature_files.text_lines(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text", chunk)


def edges(spark, head, body, chunk=feature_files.CHUNK):
    return [tuple(r)[1:] for r in sorted(corpus_files.edge_rows(numbered(spark, f"@edge\n{head}\n{body}", chunk)).collect(), key=repr)]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_edges_without_sources(spark, chunk):
    assert edges(spark, "", "1\t2\n3\n5\t6\n7-8", chunk) == [(1, 2, None), (2, 3, None), (5, 6, None), (6, 7, None), (6, 8, None)]
    assert edges(spark, "@edgeValues\n", "1\t2\t7\n3\t9\n4\n4-6,9\t1,3-4\ta\\tb\\\\n\\n", chunk) == sorted(
        [(1, 2, "7"), (2, 3, "9"), (3, 4, None), *((s, t, "a\tb\\n\n") for s in (4, 5, 6, 9) for t in (1, 3, 4))], key=repr
    )
    assert edges(spark, "", "5\n6", chunk) == [(1, 5, None), (2, 6, None)]


def values(text):
    """(node, value) by a plain loop."""
    out, node = [], 0
    for line in text.split("\n\n", 1)[1].split("\n"):
        if line:
            spec, tab, value = line.partition("\t")
            nodes = [n for part in spec.split(",") for n in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1)] if tab else [node + 1]
            node = max(nodes)
            out += [(n, value if tab else spec) for n in nodes]
    return sorted(out)


def test_a_file_in_one_and_in_many_ranges(spark, tmp_path):
    rng = random.Random(4)
    lines, node = [], 1
    for _ in range(600):
        node += rng.randrange(1, 9)
        lines.append(rng.choice(["v", "w", "", f"{node}\tx", f"{node}-{node + 3}\ty", f"{node + 4},{node}-{node + 1}\tz"]))
    text = "@node\n@valueType=str\n\n" + "\n".join(lines)
    (tmp_path / "big.tf").write_text(text)
    key = "spark.sql.files.maxPartitionBytes"
    before, found, chunks = spark.conf.get(key), [], []
    for size in (before, "64"):
        spark.conf.set(key, size)
        try:
            rows = feature_files.lines(spark, f"{tmp_path}/*.tf")
            chunks.append(rows.select("chunk").distinct().count())
            found.append(sorted((n, r.value) for r in feature_files.ranges(rows).collect() for n in range(r.first, r.last + 1)))
        finally:
            spark.conf.set(key, before)
    assert chunks[0] == 1 and chunks[1] >= 64
    assert found[0] == found[1] == values(text)


def test_lines_that_can_not_be_read(spark, tmp_path):
    bad = lambda text: [(r.line, r.problem) for r in feature_files.malformed(numbered(spark, text)).collect()]
    assert bad("@node\n\nfree text\nx\tv\n1-\tv\n1,2-3\tv") == [("x\tv", "spec"), ("1-\tv", "spec")]
    assert bad("@edge\n\n1\t2\t3\n1\tb\n1\t2\n4") == [("1\t2\t3", "fields"), ("1\tb", "spec")]
    assert bad("@edge\n@edgeValues\n\n1\t2\tfree text\n2\tfree text\nfree text") == [("free text", "spec")]
    (tmp_path / "otype.tf").write_text("@node\n\nword\nword\n")
    (tmp_path / "sp.tf").write_text("@node\n\n1,2\tverb\n")
    assert sorted(tuple(r) for r in corpus_files.load(spark, str(tmp_path), "t").nodes("word").select("node", "sp").collect()) == [(1, "verb"), (2, "verb")]
    with pytest.raises(SelectionError, match="feature_missing"):
        corpus_files.load(spark, str(tmp_path), "t", {"otype": "node", "gone": "node"})
    (tmp_path / "sp.tf").write_text("@node\n\nx,2\tverb\n")
    with pytest.raises(SelectionError, match="feature_body"):
        corpus_files.load(spark, str(tmp_path), "t")


def test_keys_that_come_twice_are_problems(spark):
    found = feature_files.headers(numbered(spark, "@node\n@x=1\n@x=2\n\nv")).first()
    assert (found.marker, found.problem, found.entries) == ("node", "key_twice", None)
    assert feature_files.headers(numbered(spark, "@node\n@x=1\n\n@x=2")).first().entries == {"x": "1"}
    assert feature_files.headers(numbered(spark, "@config\n@x=1")).first().marker == "config"
