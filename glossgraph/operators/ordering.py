"""Operators that depend on order: latest events, neighbours, running sections, canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossgraph.session import cut


def latest(events: DataFrame, by: list[Column | str], time: str, tie: str) -> DataFrame:
    """The last event of each key, summed up before any shuffle. What comes of it is for a later filter, so that a revocation counts."""
    last = F.max_by(F.struct(*events.columns), F.struct(time, tie))
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"_key{i}") for i, k in enumerate(by)]
    return events.groupBy(*keys).agg(last.alias("_last")).select("_last.*")


def last_two(events: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """The last two events of each key, numbered from the end."""
    order = Window.partitionBy(*by).orderBy(F.desc(time), F.desc(tie))
    return events.withColumn("position", F.row_number().over(order)).where("position <= 2")


def not_increasing(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't above that of the row before."""
    previous = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("previous", previous).where(F.col(value) <= F.col("previous"))


def section(rows: DataFrame, by: list[str], order: str, header: Column, into: str = "section") -> DataFrame:
    """The nearest header at or before each row; null before the first."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(header, ignorenulls=True).over(window))


def utf16(c: Column) -> Column:
    """Sort key by UTF-16 code units; it differs from the plain order beyond the basic plane alone."""
    return F.encode(c, "UTF-16BE")


def version_key(c: Column) -> Column:
    """Sort key of dotted versions, number by number."""
    return F.transform(F.split(c, r"\."), lambda x: x.cast("int"))


def time_key(text: Column) -> Column:
    """A time written by ISO 8601 as a timestamp; null where the text is none."""
    return F.try_to_timestamp(text)


def places(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add `at`, each row's place from 0 among those of its key, without gathering a key's rows.

    Rows are sorted by ranges; a range tells how many rows of each key it has, and sums of these over the ranges before
    are where it goes on. Rows that are equal in key and order are told apart by a hash of all their columns.
    """
    tie = F.xxhash64(*rows.columns)
    keys = [*by, *order, "_tie"]
    dealt = rows.withColumn("_tie", tie).withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys)
    placed = cut(dealt.drop("_salt", "_tie").withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)))
    runs = placed.groupBy(*by, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*by, "_range", "_first", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    return placed.join(runs, [*by, "_range"]).withColumn("at", F.col("_place") - F.col("_first") + F.col("_ahead")).drop("_place", "_range", "_first", "_ahead")
