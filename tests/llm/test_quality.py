from collections import Counter

from glossgraph.llm import quality


def brute_repeats(words, width=8):
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    counts = Counter(windows)
    return len({p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + width)})


TEXTS = [None, "", " \t\n", "a b c d e f g h i a b c d e f g h", "x " * 500, "one\ntwo\none\n \n\ntwo\none", "é#*$ |<>& \x0b y\x1cz", "la " * 8 + "lo " * 9, "w" * 100000]


def test_repeated_words_match_brute_force():
    for t in TEXTS + ["a b " * 20 + "c d e f g h i j k " * 3]:
        words = (t or "").encode().split()
        assert quality.repeated_words(words) == brute_repeats(words)


def test_ledger_and_policies(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").withColumn("n_words", quality.F.lit("clash"))
    rows = quality.judge(quality.ledger(df)).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.n_words == "clash" for r in rows)
    by = {r.doc_id: r.ledger for r in rows}
    assert by[0].asDict() == by[1].asDict() and by[0].n_words == 0 and by[0].fail_bits & quality.BIT["too_few_words"]
    assert by[5].n_dup_lines == 3 and by[5].n_lines == 5
    assert by[6].n_words == 3 and by[6].n_symbols == 7 and by[6].word_chars == len("é#*$|<>&y\x1cz")
    assert by[4].fail_bits & quality.BIT["repeated_windows"]
    assert quality.ledger(df.limit(0)).count() == 0


def test_ablations_agree_with_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ledgered = quality.ledger(docs)
    bits = [r.b for r in ledgered.select(quality.F.col("ledger.fail_bits").alias("b")).collect()]
    for r in quality.ablations(ledgered).collect():
        mask, bit = quality.POLICIES[r.version], quality.BIT[r.rule]
        assert r.documents == len(bits)
        assert r.rejected == sum(b & mask != 0 for b in bits)
        assert r.failing == sum(b & bit != 0 for b in bits)
        assert r.rejected_by_it_alone == sum(b & mask == bit for b in bits)
