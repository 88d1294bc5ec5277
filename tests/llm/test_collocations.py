"""Collocations against plain loops: counts, cuts, covering, ranks; shards and filters don't change results."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from glossgraph.llm import collocations


def counted(rows):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return n, f


def expected(rows, least, top):
    n, f = counted(rows)
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, words), a in often.items():
        if any(lang == other and len(longer) > len(words) and 100 * b >= 80 * a and any(longer[i : i + len(words)] == words for i in range(len(longer))) for (other, longer), b in often.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "and", "größe", "ÉTÉ", "été", "x", "a b", "\x1c", "new", "york", "city", "hall"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(0, 40)):
            text += rng.choice([*words, "new york city hall", "a b c d e", "same same same"]) + rng.choice([" ", " ", " ", "\t", "  ", ".", ",\n", "\x0b", "\r"])
        out.append((text, rng.choice(["en", "en", "en", "de", None])))
    return [*out, (None, "en"), ("", None), (" . . ", "fr"), out[0], out[0]]


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_collocations_are_those_of_plain_loops(spark, shards):
    rows = rows_of(shards, 150)
    docs = spark.createDataFrame([(t, x, "kept", 1) for t, x in rows], "text string, lang string, phrase string, n int").repartition(5)
    found = collocations.mine(docs, least=12, shards=shards)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert plain(found) == sorted(expected(rows, 12, 2000))
    assert {x for x, *_ in expected(rows, 12, 2000)} >= {"en", "de", "und"}


def test_ranks_end_at_top_and_ties_go_by_bytes(spark):
    pairs = [f"{x} {x}{x}" for x in "abcdefgh"] + ["é éé", "z zz"]
    rows = [(". ".join(pairs), "en")] * 5
    found = collocations.mine(spark.createDataFrame(rows, "text string, lang string"), least=5, top=9)
    assert [r.phrase for r in found.orderBy("rank").collect()] == sorted(pairs, key=str.encode)[:9]


def test_small_filters_and_pages_change_nothing(spark, monkeypatch):
    rows = rows_of(7, 120)
    monkeypatch.setattr(collocations, "FILTER_BITS", 10)
    monkeypatch.setattr(collocations, "PAGE_BYTES", 300)
    monkeypatch.setattr(collocations, "BATCH", 50)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 20)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert plain(collocations.mine(docs, least=8)) == sorted(expected(rows, 8, 2000))


def test_phrases_that_start_late_see_every_shard(spark):
    """A phrase whose words reach the threshold in the last shard alone is still counted over all shards."""
    rows = [(f"filler {k}. rare pair here.", "en") for k in range(40)]
    phrases, totals = collocations.frequent(spark.createDataFrame(rows, "text string, lang string").repartition(40), least=40, shards=4)
    assert {r.phrase: r.n for r in phrases.collect()} == dict.fromkeys(["rare", "pair", "here", "rare pair", "pair here", "rare pair here"], 40)
    assert [tuple(r) for r in totals.collect()] == [("en", 40 * 5)]


def test_filters_hold_all_that_was_put_in():
    hashes = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    bits = np.zeros(1 << 10, dtype=np.uint8)
    for place in collocations.Filter.places(hashes, 13):
        np.bitwise_or.at(bits, place >> np.uint64(3), np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8)))
    assert collocations.Filter(13, bits).has(hashes).all()


def test_scores_are_exact_beyond_64_bits(spark):
    big = 2**60 + 1
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 2)], "lang string, k int, phrase string, n long")
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    row = collocations.scored(phrases, totals).first()
    assert row.score == 2_000_000 * (big - 2) // (big + big + 2) and row.l == big


def test_empty_tables_and_very_long_texts(spark):
    docs = spark.createDataFrame([("new york " * 300_000, None)], "text string, lang string")
    assert [(r.lang, r.rank, r.phrase, r.a) for r in collocations.mine(docs).where("rank = 1").collect()] == [("und", 1, "new york new york", 299_999)]
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.selectExpr("cast(null as string) AS text", "lang")).count() == 0
