import random

import corpus_pipeline
from glossgraph.llm import mixing


def test_stages_keep_their_contracts(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{name}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in seen["toxicity"][1].collect()}
    assert len(toxic & kept) <= 0.4 * len(toxic) and len(clean - kept) <= 0.02 * len(clean)
    before, after = (df.collect() for df in seen["simhash_near_dedup"])
    assert {r.text for r in after} <= {r.text for r in before} and len({r.text for r in after}) == len(after)
    assert len(after) >= 0.7 * len(before)
    before, after = ({r.doc_id: r for r in df.collect()} for df in seen["pii"])
    assert before.keys() == after.keys() and not any("@" in r.text and "example.com" in r.text.split("@", 1)[1][:40] for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = (df.collect() for df in seen["source_mixing"])
    words = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert abs(words(after) - mixing.SHARE * words(before)) < 0.1 * words(before)
    packed = seen["best_fit_packing"][1].collect()
    assert len(packed) >= len(after) and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_odd_documents_pass_through(spark):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "some text", None, "s", 9), (2, "", "de", "s", 0), (3, "w " * 30000, "fr", "t", 60000), (4, "mail a@b.example.com " * 3, "es", "t", 63)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        sizes[name] = docs.count()
    assert sizes["toxicity"] == 6 and sizes["simhash_near_dedup"] == sizes["pii"] == 4
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "/root/testdata/sf0.001").count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, texts):
    """Numbers of the (id, text) pairs that the near-duplicate stage keeps."""
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(texts)], DOCS)
    return {r.n_chars for r in corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.001").collect()}


def test_only_texts_of_similar_shingles_are_copies(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(204)]
    shuffled = rng.sample(words, 204)
    # 5 scattered words leave 175 of 225 shingles, 4 leave 180 of 220
    loose, near = ([f"x{k}" if k % 40 == 20 and k < 40 * n else w for k, w in enumerate(words)] for n in (5, 4))
    assert kept(spark, [(1, " ".join(words)), (2, " ".join(shuffled))]) == {0, 1}
    assert kept(spark, [(1, " ".join(words)), (2, " ".join(loose))]) == {0, 1}
    assert kept(spark, [(1, " ".join(words)), (2, " ".join(near))]) == {0}


def test_one_of_a_group_stays_where_ids_are_null_or_shared(spark):
    words = [f"w{k}" for k in range(204)]
    copies = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (20, 90, 150)]
    for key in (None, 5):
        left = kept(spark, [*((key, t) for t in copies), (key, "a text like none of the others here"), (9, copies[0])])
        assert len(left & {0, 1, 2, 4}) == 1 and 3 in left


def chorus(seed, own):
    """Two texts of one fingerprint, as most of their shingles are those of a chorus; `own` words at the end differ."""
    sung, body = ([f"{c}{seed}x{k}" for k in range(n)] for c, n in (("c", 3), ("w", 142)))
    return [" ".join([*sung * 120, *body, *(f"{c}{seed}x{k}" for k in range(own))]) for c in "ab"]


def test_fingerprints_find_copies_that_share_no_band(spark):
    # 145 of 181 shingles, and none of the 20 bands for these seeds
    texts = [t for seed in (78, 1116, 1209) for t in chorus(seed, 18)]
    assert kept(spark, list(enumerate(texts))) == {0, 2, 4}
    # 145 of 183 shingles: the same fingerprint alone makes no copy
    assert kept(spark, list(enumerate(chorus(78, 19)))) == {0, 1}
