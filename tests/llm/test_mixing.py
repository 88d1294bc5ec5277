import pytest

from glossgraph.llm import mixing


def fill(sizes, weights, share=1.5, most=2):
    """Water filling, one round after the other."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total, at = share * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        left = total - sum(at.values())
        tried = {n: left * w[n] / sum(w[m] for m in open_) for n in open_}
        over = {n for n in open_ if tried[n] > most * sizes[n] + 1e-9}
        if not over:
            return at | tried
        at |= {n: most * sizes[n] for n in over}
        open_ -= over
    return at


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 900, "c": 20, "d": 0, None: 50}, {"é": 5, "z": 7}, {None: 3}, {"a": 0}])
def test_targets_match_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = fill(sizes, mixing.WEIGHTS)
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-6 for n in want)


def test_mix_hits_targets_and_is_repeatable(spark):
    rows = [(i, None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", i * 7919 % 900) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    mixed = mixing.mix(df, "n")
    first, again = mixed.collect(), mixing.mix(df.repartition(7), "n").collect()
    assert sorted((r.doc_id, r.copies) for r in first) == sorted((r.doc_id, r.copies) for r in again)
    assert len(first) == 3000 and all(0 <= r.copies <= 2 for r in first)
    for source in {r.source for r in first}:
        mine = [r for r in first if r.source == source]
        taken, rate = sum(r.copies * r.n for r in mine), mine[0].target / mine[0].source_size
        assert abs(taken - mine[0].target) < 1500
        assert abs(sum(r.copies for r in mine) - rate * len(mine)) <= 1.0001
    assert mixing.emit(mixed).count() == sum(r.copies for r in first)


def test_expectations_of_any_kind_are_crossed_exactly(spark):
    rows = [(i, "x", 10, e) for i, e in enumerate([0.5, 0.0, 1.0, 2.75, None, 0.25, 1.5, 3.0])]
    got = {r.id: r for r in mixing.copies(spark.createDataFrame(rows, "id long, s string, n long, e double"), "e", "s", "n", "id").collect()}
    assert all(int(r.e or 0) <= r.copies <= -(-(r.e or 0) // 1) for r in got.values())
    assert sum(r.copies for r in got.values()) in (9,)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, None, None), (1, "a", 0), (1, "a", 0), (2, "", 5)]
    assert mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n long"), "n").count() == 4
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, n long"), "n").count() == 0
