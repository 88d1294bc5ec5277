import numpy as np

from glossgraph.llm import langid
from glossgraph.llm.queries import op8_language_id


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    assert model.languages == ("de", "en", "es", "fr")
    rows = docs.where("doc_id % 2 = 1").select("lang", "text").collect()
    got = model.evidence([r.text for r in rows]).argmax(axis=1)
    right = sum(model.languages[k] == r.lang for k, r in zip(got, rows, strict=True))
    assert right >= 0.97 * len(rows)


def test_query_agrees_with_labels_and_declarations(spark):
    rows = op8_language_id(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    mine = [r for r in rows if r.doc_id is not None]
    assert len(mine) == len(docs) and len(rows) == len(docs) + 50
    assert sum(r.lang == docs[r.doc_id] for r in mine) >= 0.95 * len(mine)
    pages = [r for r in rows if r.page_id is not None]
    assert sum(r.lang == r.declared for r in pages) >= 0.9 * len(pages)


def test_fusion_matches_bayes_by_hand(spark):
    model = langid.LanguageModel(("aa", "bb"), np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS)).astype(np.float32))
    rows = [(k, None, d, h, "d.x", "x") for k, (d, h) in enumerate([("aa", "h1"), ("bb", "h1"), (None, "h2"), ("aa", None)])]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    got = {r.id: r for r in langid.identify(df, model).collect()}
    # texts say nothing, so each row counts as half of each language, and declarations decide alone
    base = (2.0 + 0.5) / 5
    up = ((2 + 8 * base) / 12 * 8 + 2) / 12
    prior = (2 - 1 + 8 * up - 0.5 + 0.5) / (2 - 1 + 8)
    assert abs(prior - 0.5) < 0.2
    said = (1.0 + 20 * 0.9) / (1.0 + 20 * 0.9 + 0.5 + 20 * 0.1)
    assert got[0].lang == "aa" and abs(got[0].p - said / (said + (0.5 * 2 + 20 * 0.1) / (0.5 * 2 + 20 * 0.1 + 0.5 + 18.0))) < 0.1
    assert got[1].lang == "bb" and abs(got[2].p - 0.5) < 1e-9 and got[3].lang == "aa"


def test_hosts_lean_on_their_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    text = {r.lang: r.text for r in docs.orderBy("doc_id").collect()}
    rows = [(k, text["de"], None, "h.de", "h.de", "de") for k in range(30)] + [(99, "zz", None, "h.de", "h.de", "de"), (100, "zz", None, "n.de", "n.de", "de"), (101, None, None, None, None, None)]
    got = {r.id: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string"), model).collect()}
    assert got[99].lang == "de" and got[100].lang == "de" and got[99].p >= got[100].p > 0.5 and len(got) == 33


def test_parsing_and_empty_tables(spark):
    df = spark.createDataFrame([("HTTPS://User@WWW.Example.co.UK:80/x?y", '<!doctype html><HTML class="a" LANG=\'DE-at\'><script>x<y</script>Hallo<br>Welt'), (None, None), ("nothing", "<html>")], "u string, h string")
    host, domain, suffix = langid.address(langid.F.col("u"))
    r = df.select(host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), langid.declared(langid.F.col("h")).alias("lang"), langid.visible_text(langid.F.col("h")).alias("text")).collect()
    assert (r[0].host, r[0].domain, r[0].suffix, r[0].lang) == ("www.example.co.uk", "co.uk", "uk", "de") and r[0].text.split() == ["Hallo", "Welt"]
    assert r[1].host is None and r[2].host is None and r[2].lang is None
    empty = spark.createDataFrame([], "id long, text string, declared string, host string, domain string, suffix string")
    assert langid.identify(empty, langid.LanguageModel((), np.zeros((0, langid.BUCKETS)))).count() == 0
    assert langid.identify(empty, langid.LanguageModel(("a", "b"), np.zeros((2, langid.BUCKETS), dtype=np.float32))).count() == 0
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == ()


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def fused_plainly(rows, model):
    """All levels of the hierarchy by dictionaries, a row at a time: (text_lang, lang, p) of (text, declared, host, domain, suffix)."""
    languages, n = model.languages, len(model.languages)
    likely = []
    for text, *_ in rows:
        raw = (text or "").lower().encode()
        grams = [((raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77 + raw[i + 2] * 0xC2B2AE3D) % 2**32) >> 18 for i in range(len(raw) - 2)]
        weight = 1 / (1 + len(grams) / langid.EVIDENCE)
        likely.append([sum(float(model.table[k][g]) for g in grams) * weight if grams else 0.0 for k in range(n)])
    own = [softmax(x) for x in likely]
    levels = {}
    for (_, _, host, domain, suffix), mine in zip(rows, own, strict=True):
        for key in ((), (suffix,), (suffix, domain), (suffix, domain, host)):
            total, count = levels.get(key, (np.zeros(n), 0))
            levels[key] = total + mine, count + 1
    top, count = levels[()]
    base = (top + 1 / n) / (count + 1)

    def lean(key, parent):
        total, size = levels[key]
        return (total + langid.STRENGTH * parent) / (size + langid.STRENGTH)

    said = {}
    for d in languages:
        seen = sum((mine for (_, declared, *_), mine in zip(rows, own, strict=True) if declared == d), np.zeros(n))
        said[d] = seen + langid.DECLARED_WEIGHT * np.array([langid.DECLARED_RIGHT if d == x else (1 - langid.DECLARED_RIGHT) / (n - 1) for x in languages])
    whole = sum(said.values())
    out = []
    for (_, declared, host, domain, suffix), mine, ll in zip(rows, own, likely, strict=True):
        up = lean((suffix, domain), lean((suffix,), base))
        total, size = levels[suffix, domain, host]
        prior = (np.maximum(total - mine, 0) + langid.STRENGTH * up) / (size - 1 + langid.STRENGTH)
        spoken = np.log(said[declared] / whole) if declared in said else 0
        post = softmax(np.array(ll) + spoken + np.log(np.maximum(prior, 1e-9)))
        out.append((languages[int(np.argmax(mine))], languages[int(np.argmax(post))], post.max()))
    return out


def test_query_is_that_of_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    docs, pages = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "pages"))
    host, domain, suffix = langid.address(langid.F.col("url"))
    markup = pages.select("page_id", langid.visible_text(langid.F.col("html")).alias("t"), langid.declared(langid.F.col("html")).alias("d"), host.alias("h"), domain.alias("m"), suffix.alias("s")).collect()
    every = docs.collect()
    keys = [("doc", r.doc_id) for r in every] + [("page", r.page_id) for r in markup]
    rows = [(r.text, None, None if r.source is None else "source:" + r.source, None, None) for r in every] + [(r.t, r.d, r.h, r.m, r.s) for r in markup]
    want = dict(zip(keys, fused_plainly(rows, langid.fit(docs)), strict=True))
    got = {("page", r.page_id) if r.doc_id is None else ("doc", r.doc_id): r for r in op8_language_id(spark, folder).collect()}
    assert got.keys() == want.keys()
    for k, (text_lang, lang, p) in want.items():
        assert (got[k].text_lang, got[k].lang) == (text_lang, lang) and abs(got[k].p - p) < 1e-6 and got[k].kept == (got[k].p >= langid.KEEP), k


def test_long_texts_repeated_rows_ties_and_clashing_columns(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    long = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'fr'").first().text * 400
    rows = [(1, long, "x", 0.5, True), (2, None, "x", 0.5, True), (2, None, "x", 0.5, True), (3, "", "x", 0.5, True)]
    df = spark.createDataFrame(rows, "id int, text string, lang string, p double, kept boolean").selectExpr("*", "CAST(NULL AS STRING) AS declared", "'h' AS host", "'d' AS domain", "'s' AS suffix", "7 AS other")
    got = sorted(langid.identify(df, model).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == [1, 2, 2, 3] and got[0].text_lang == got[0].lang == "fr" and got[1] == got[2] and got[1].p == got[3].p
    assert all(r.other == 7 and r.lang in model.languages for r in got)
    assert got[1].text_lang == model.languages[0]  # of equal languages the first
