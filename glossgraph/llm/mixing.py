"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies. Within its source, documents stand in a fixed order, the
expected copies are summed up to each of them, one offset is added for the source, and a document is emitted
once for each integer that the sum crosses. All sums are integers in units of 2**-32, so they are exact and
don't depend on how Spark groups them.

The order is by classes of similar size, then by a hash. Sums come from three levels (size classes of a source,
slots of a class, documents of a slot), so no task orders more than the documents of one slot, whatever share
of the rows one source or one size has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1 << 32
#: Slots of a size class within a source.
SLOTS = 128
#: Weights of the sources in turn, by code point order of their names.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Add `target` to a table of (source, source_size): words that each source should give to the mix.

    Sources take the weights in turn, by code point, null last. Together they get `share` of all sizes, by
    weight; no target exceeds `most` times its source's size, and what is over is shared again by weight. The
    closed form: sorted by size over weight, the first sources are at their limit, and the rest split what is
    left by weight. One row a source, so the window over all of them is as small as the list of sources.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    # the level that this source and all after it would get; it holds from the first source that stays below its limit
    open_level = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.first(open_level, ignorenulls=True).over(everything))
        .withColumn("target", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")))
        .drop("weight", "limit", "level")
    )


def _hashed(key: Column) -> Column:
    """32 bits of a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes for each doubling of a size, as text that sorts by size."""
    bits = F.bin(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 1)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 3), 3, "0"))


def copies(docs: DataFrame, expected: str, by: str, size: str, doc_id: str, seed: int = 0, into: str = "copies") -> DataFrame:
    """Add the number of copies that systematic sampling emits for each document.

    `expected` is the expected number of copies, at least 0 (null: 0); `by` may be null, which is a source of
    its own. A document gets the whole part of its expectation or one more. Reruns agree; rows that are equal
    in id, size and expectation may swap their copies. Columns whose names begin with _mix_ are replaced.
    """
    key = F.col(doc_id)
    marked = docs.withColumns(
        {
            "_mix_units": F.round(F.coalesce(F.col(expected), F.lit(0.0)) * F.lit(float(UNIT))).cast("decimal(20,0)"),
            "_mix_class": size_class(F.col(size)),
            "_mix_hash": F.coalesce(_hashed(key), F.lit(0).cast("long")),
            "_mix_by": F.struct(F.col(by).isNull().alias("none"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("name")),
        }
    ).withColumn("_mix_slot", F.pmod(F.col("_mix_hash"), F.lit(SLOTS)).cast("int"))
    exact = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    slots = marked.groupBy("_mix_by", "_mix_class", "_mix_slot").agg(exact(F.sum("_mix_units")).alias("_mix_in"))
    classes = slots.groupBy("_mix_by", "_mix_class").agg(exact(F.sum("_mix_in")).alias("_mix_in"))
    classes = classes.select("_mix_by", "_mix_class", exact(F.sum("_mix_in").over(before(["_mix_by"], "_mix_class"))).alias("_mix_classes"))
    slots = slots.select("_mix_by", "_mix_class", "_mix_slot", exact(F.sum("_mix_in").over(before(["_mix_by", "_mix_class"], "_mix_slot"))).alias("_mix_slots"))
    starts = slots.join(classes, ["_mix_by", "_mix_class"]).select(
        "_mix_by", "_mix_class", "_mix_slot", (F.col("_mix_classes") + F.col("_mix_slots")).cast("decimal(38,0)").alias("_mix_start")
    )
    order = Window.partitionBy("_mix_by", "_mix_class", "_mix_slot").orderBy(F.col(size), "_mix_hash", key, "_mix_units")
    offset = _hashed(F.concat(F.lit(f"{seed}:"), F.col("_mix_by.name"))).cast("decimal(20,0)")
    crossed = f"CAST(_mix_last div {UNIT} - (_mix_last - _mix_units) div {UNIT} AS INT)"
    return (
        marked.withColumn("_mix_sum", exact(F.sum("_mix_units").over(order.rowsBetween(Window.unboundedPreceding, 0))))
        .join(starts, ["_mix_by", "_mix_class", "_mix_slot"])
        .withColumn("_mix_last", (F.col("_mix_sum") + F.col("_mix_start") + offset).cast("decimal(38,0)"))
        .withColumn(into, F.expr(crossed))
        .drop(*(f"_mix_{x}" for x in ("units", "class", "hash", "by", "slot", "sum", "start", "last")))
    )


def mix(docs: DataFrame, size: str, by: str = "source", doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """Add source_size, target (words of the document's source) and copies.

    Empty tables give empty results; documents of size 0 are sampled like others and take no words.
    """
    sources = docs.groupBy(F.col(by).alias("source")).agg(F.sum(size).alias("source_size"))
    targets = source_targets(sources).withColumnRenamed("source", "_of")
    # plain equality of a null-free key lets Spark split a source that has a large part of the rows
    name = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c.cast("string"), F.lit("")))
    targets = targets.select(name(F.col("_of")).alias("_name"), F.col("source_size"), F.col("target"))
    rated = docs.drop("source_size", "target").withColumn("_name", name(F.col(by))).join(targets, "_name").drop("_name")
    rated = rated.withColumn("_expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    return copies(rated, "_expected", by, size, doc_id, seed).drop("_expected")


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, numbered from 0 in `copy`; documents without copies go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
