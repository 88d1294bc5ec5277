import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from glossgraph.llm import simhash
from glossgraph.llm.components import connected_components
from glossgraph.llm.queries import op5_simhash_near_dedup


def brute_print(text):
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashed) > len(hashed))


def brute_components(prints):
    """doc -> smallest reachable doc, over all pairs."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[i + 1 :]:
            if bin((p ^ q) & (2**64 - 1)).count("1") <= 3 and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d, _ in prints}


def test_blocks_meet_every_pair_of_three_bits():
    assert len(simhash.BLOCKS) == 14
    for a in range(8):
        for b in range(8):
            for c in range(8):
                assert any(not {a, b, c} & set(block) for block in simhash.BLOCKS)


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    prints = [(d, brute_print(t)) for d, t in texts]
    want = brute_components(prints)
    got = op5_simhash_near_dedup(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint == f"{dict(prints)[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_links_of_long_lists_lose_nothing(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(60)} | {0, 1, 2**64 - 1}
    signed = [(p - (p >> 63 << 64),) for p in prints]
    want = brute_components([(p, p) for (p,) in signed])
    df = spark.createDataFrame(signed, "fp long").repartition(4)
    for most in (4096, 6):  # the small bound makes lists be posted again
        found = simhash.links(df, most)
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in found.collect())
        comps = {r.node: r.component for r in connected_components(found, "a", "b").collect()}
        groups = {}
        for p in want:
            groups.setdefault(want[p], set()).add(comps.get(p, p))
        assert all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_nulls_empties_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b C"), (4, "a B c"), (9, "a b c"), (10, "word " * 50000), (11, "other text with more words than those")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[4] == comp[9] == 4 and comp[11] == 11
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_find_edited_texts_and_leave_others(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    rows, groups = [], {}
    for g in range(30):
        base = [word() for _ in range(200)]
        for _ in range(5):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(len(copy))] = word()
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    for most in (simhash.MOST, 3):
        comp = {r.doc_id: r.component_id for r in simhash.near_copies(df, most=most).collect()}
        assert comp[1000] == comp[1001] == 1000
        assert sum(comp[d] == 5 * g for d, g in groups.items()) >= 148
        assert all(comp[d] // 5 == g for d, g in groups.items())


def test_majority_bits_of_long_runs():
    rng = np.random.default_rng(1)
    hashed, sizes = rng.integers(0, 2**64, 2000, dtype=np.uint64), np.array([0, 700, 1, 0, 1299])
    got = simhash.majority_bits(hashed, sizes)
    at = 0
    for g, n in zip(got.tolist(), sizes.tolist(), strict=True):
        part = hashed[at : at + n].tolist()
        at += n
        assert g == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in part) > n)


def some_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_lists_longer_than_the_bound_lose_no_copy(spark):
    rng = random.Random(7)
    rows = []
    for g in range(3):
        base = some_words(rng, 200)
        for _ in range(40):
            copy = list(base)
            copy[rng.randrange(200)] = some_words(rng, 1)[0]
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (simhash.MOST, 3):
        assert all(r.component_id == r.doc_id // 40 * 40 for r in simhash.near_copies(df, most=most).collect())


def test_blocks_of_a_long_list_meet_every_pair_that_can_be_alike(spark):
    sizes = {k: 100 + 3 * k for k in range(50)}
    rows = [(key, k, n) for key in (1, 2) for k, n in sizes.items()] + [(3, 0, 100), (3, 1, 103), (4, 7, 121)]
    posted = spark.createDataFrame(rows, "key long, node long, size long").repartition(5)
    tasks = {}
    for r in simhash.band_tasks(posted, 7, 0.8).collect():
        tasks.setdefault((r.key, r.a, r.b), set()).add(r.node)
    met = {(a, b) for members in tasks.values() for a in members for b in members if a < b}
    assert {(a, b) for a in sizes for b in sizes if a < b and sizes[a] >= 0.8 * sizes[b]} <= met
    assert max(map(len, tasks.values())) <= 16 and len({k for k, _, _ in tasks}) == 2


def five_grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_copies_are_found_whatever_the_edit(spark):
    rng = random.Random(11)
    edits = {
        "end cut off": lambda w: w[: int(len(w) * 0.85)],
        "text appended": lambda w: w + some_words(rng, len(w) // 6),
        "block replaced": lambda w: w[: len(w) // 2] + some_words(rng, len(w) // 14) + w[len(w) // 2 + len(w) // 14 :],
        "words replaced": lambda w: [some_words(rng, 1)[0] if rng.random() < 0.018 else x for x in w],
    }
    rows, wanted = [], {}
    for kind, edit in edits.items():
        for _ in range(40):
            words = some_words(rng, rng.randint(60, 600))
            texts = " ".join(words), " ".join(edit(words))
            a, b = map(five_grams, texts)
            wanted[len(rows)] = kind, len(a & b) / len(a | b) >= 0.8
            rows += [(len(rows), texts[0]), (len(rows) + 1, texts[1])]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), least=0.8).collect()}
    for kind in edits:
        alike = [d for d, (k, near) in wanted.items() if k == kind and near]
        assert len(alike) > 15 and sum(got[d + 1] == d for d in alike) >= len(alike) - 1, kind
    assert all(got[d + 1] == d + 1 for d, (_, near) in wanted.items() if not near)


def long_list(rng, common, n):
    """Texts that are one boilerplate and some words of their own, so that they share bands but are not alike."""
    return [" ".join([*common, *some_words(rng, len(common))]) for _ in range(n)]


def components(spark, texts, most):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.near_copies(df, most=most, least=0.8).collect()}


def test_long_lists_of_texts_with_one_boilerplate(spark):
    """All pairs by brute force: a boilerplate alone links nothing, copies among the texts are found."""
    rng = random.Random(21)
    texts = long_list(rng, some_words(rng, 60), 150)
    texts += [t.rsplit(" ", 4)[0] for t in texts[:40]]
    grams = [five_grams(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert len(set(root)) == 150
    for most in (simhash.MOST, 20):
        got = components(spark, texts, most)
        assert sum(got[d] != root[d] for d in got) <= 1, most  # the index is probabilistic


def test_work_on_long_lists_grows_with_their_length(spark, monkeypatch):
    """Members of all comparisons of one list: with four times the members, not sixteen times as many."""
    def compared(texts):
        rows, plain = [], simhash.similar_links
        monkeypatch.setattr(simhash, "similar_links", lambda tasks, sets, least: rows.append(tasks.count()) or plain(tasks, sets, least))
        got = components(spark, texts, 16)
        monkeypatch.setattr(simhash, "similar_links", plain)
        return sum(rows), got

    rng = random.Random(3)
    base = some_words(rng, 120)
    copies = [" ".join([*base[:k], some_words(rng, 1)[0], *base[k + 1 :]]) for k in (rng.randrange(120) for _ in range(320))]
    few, many = compared(copies[:80]), compared(copies)
    assert set(few[1].values()) == set(many[1].values()) == {0}
    assert many[0] < 7 * few[0], (few[0], many[0])
    pages = long_list(rng, some_words(rng, 60), 320)
    few, many = compared(pages[:80]), compared(pages)
    assert all(c == d for d, c in many[1].items())
    assert many[0] < 7 * few[0], (few[0], many[0])


def test_groups_hold_any_two_fingerprints_within_the_radius(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(30)})
    signed = [p - (p >> 63 << 64) for p in prints]
    # two sets of shingles for each fingerprint; texts without words are in no group
    rows = [(p, 2 * k + n, 5) for k, p in enumerate(signed) for n in range(2)] * 2 + [(0, 999, 0)]
    got = simhash.fingerprint_groups(spark.createDataFrame(rows, "fp long, node long, size long")).collect()
    key = {r.node: r.key for r in got}
    assert len(got) == len(key) == 2 * len(prints) and all(r.comp == r.node and r.size == 5 for r in got)
    want = brute_components([(p, p) for p in signed])
    groups = {}
    for k, p in enumerate(signed):
        groups.setdefault(want[p], set()).update((key[2 * k], key[2 * k + 1]))
    assert all(len(x) == 1 for x in groups.values()) and len(set().union(*groups.values())) == len(groups)


def tasks_of(spark, run):
    """Tasks that Spark ran for `run`."""
    context, group = spark.sparkContext, str(random.random())
    context.setJobGroup(group, "counted")
    run()
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)


def test_components_of_a_few_links_need_few_tasks(spark):
    """Each task leaves files; rounds over a few links may not have tasks for each partition of each shuffle."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)], "a long, b long")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert tasks_of(spark, lambda: connected_components(links, "a", "b").count()) < 25 * 64
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_components_match_brute_force_where_tables_have_several_files_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr("glossgraph.llm.common.FILE_ROWS", 20)
    monkeypatch.setattr("glossgraph.llm.components.HOT_ROWS", 4)
    monkeypatch.setattr("glossgraph.llm.components.HOT_KEYS", 100)
    rng = random.Random(13)
    chain = [(a, a + 1) for a in rng.sample(range(300, 340), 40)]
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(205, k) for k in range(200, 230)] + chain + [(None, 5), (7, 7)]
    root = {x: x for pair in pairs for x in pair}
    for a, b in pairs * 2:
        if None not in (a, b):
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
    got = [(r.node, r.component) for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()]
    linked = {x for a, b in pairs if a != b and None not in (a, b) for x in (a, b)}
    assert sorted(got) == sorted((x, root[x]) for x in linked)


def test_estimates_of_sizes_stay_small_over_rounds_of_joins(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    for _ in range(2):
        comps = connected_components(links, "a", "b")
        links = comps.join(comps.withColumnRenamed("node", "b"), "component").select(F.col("node").alias("a"), "b")
    assert {r.component for r in comps.collect()} == {0}
    assert comps._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**200
