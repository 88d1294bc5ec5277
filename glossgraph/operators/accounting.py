"""Coverage accounting: what is reviewed, who owns the rest, and what changed between releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.operators.census import label
from glossgraph.operators.selectors import SelectionError
from glossgraph.session import cut

BUCKETS = ("C", "D", "E", "F", "G", "H")


def item_id(kind: str, feature: Column, value: Column | None = None) -> Column:
    """`kind:feature`, or `kind:feature=<JSON string>` for a value."""
    head = F.concat(F.lit(f"{kind}:"), feature)
    return head if value is None else F.concat(head, F.lit("="), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))


def item_parts(item: Column) -> tuple[Column, Column, Column]:
    """Kind, feature, and the value's JSON (null without one): split at the first colon and the first equals sign."""
    rest = F.regexp_extract(item, r"^[^:]*:(?s)(.*)$", 1)
    value = F.regexp_extract(rest, r"^[^=]*=(?s)(.*)$", 1)
    return F.substring_index(item, ":", 1), F.substring_index(rest, "=", 1), F.when(F.contains(rest, F.lit("=")), value)


def pointer_token(text: Column) -> Column:
    """A JSON pointer's token."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def coverage_report(items: DataFrame, accounting: DataFrame, by: list[str]) -> DataFrame:
    """(…, items, reviewed, common, unreviewed) from (by, item_id) and (item_id, assessment, target)."""
    per_item = accounting.groupBy("item_id").agg(F.max(F.col("target").isNotNull().cast("int")).alias("shared"))
    joined = items.join(per_item, "item_id", "left")
    one = lambda c: F.sum(c.cast("int")).cast("long")
    return joined.groupBy(*by).agg(
        F.count("*").alias("items"), one(F.col("shared").isNotNull()).alias("reviewed"), one(F.coalesce(F.col("shared") == 1, F.lit(False))).alias("common"), one(F.col("shared").isNull()).alias("unreviewed")
    )


def research_accounting(rows: DataFrame) -> DataFrame:
    """(item_id, assessments, has_target, sources): one row for each item, lists sorted and joined by +."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "+")
    return rows.groupBy("item_id").agg(joined("assessment").alias("assessments"), F.max(F.col("target").isNotNull()).alias("has_target"), joined("source_id").alias("sources"))


def weighted_coverage(rows: DataFrame, by: str, weight: str, covered: Column) -> DataFrame:
    """(by, total, covered, tenths): weights, and covered per thousand rounded half to even."""
    return rows.groupBy(by).agg(F.sum(weight).alias("total"), F.coalesce(F.sum(F.when(covered, F.col(weight))), F.lit(0)).alias("covered")).withColumn(
        "per_mille", F.bround(F.lit(1000) * F.col("covered") / F.col("total"), 0).cast("long")
    )


def exact_sums(rows: DataFrame, by: list[str], sums: dict[str, str], *others: Column) -> DataFrame:
    """(by, sums, others): sums of integer columns, {name: column}, that are exact at any size.

    A column of sums is bigint if all of them fit, else decimal(38,0). As just the sums tell which, they are made at once.
    """
    wide = cut(rows.groupBy(*by).agg(*(F.sum(F.col(c).cast("decimal(28,0)")).alias(n) for n, c in sums.items()), *others))
    fits = wide.agg(*(F.every(F.col(n).isNull() | F.col(n).try_cast("bigint").isNotNull()).alias(n) for n in sums)).first()
    return wide.withColumns({n: F.col(n).cast("bigint") for n in sums if fits[n] is not False})


def route(items: DataFrame, routes: DataFrame, on: str, default: str = "H", assessed: Column | None = None) -> DataFrame:
    """Each item with its owner: a route's, else what was assessed, else the default. An item with two routes is refused by `owners`."""
    residual = F.lit(default) if assessed is None else F.coalesce(assessed, F.lit(default))
    return items.join(routes.select(on, F.col("owner").alias("_owner")), on, "left").withColumn("owner", F.coalesce(F.col("_owner"), residual)).drop("_owner")


def owners(routes: DataFrame, on: str) -> DataFrame:
    """Items with several owners: none may be."""
    return routes.groupBy(on).agg(F.count_distinct("owner").alias("n")).where("n > 1")


def queue(routed: DataFrame, by: str, buckets: tuple[str, ...] = BUCKETS) -> DataFrame:
    """One row for each key with a count for each bucket, 0 where there are none."""
    return routed.groupBy(by).pivot("owner", list(buckets)).agg(F.count(F.lit(1))).na.fill(0)


def queue_totals(routed: DataFrame, by: str) -> DataFrame:
    """(by, owner, n) with totals: null stands for all."""
    return routed.rollup(by, "owner").agg(F.count("*").alias("n"))


def gaps(used: DataFrame, denominator: DataFrame, on: str = "item_id") -> DataFrame:
    """Items that are accounted for, but aren't in the denominator."""
    return used.join(denominator, on, "left_anti")


def reconcile(defined: DataFrame, observed: DataFrame, on: str) -> DataFrame:
    """(on, state): every code as both, defined-only or observed-only."""
    both = defined.select(on, F.lit(True).alias("_d")).join(observed.select(on, F.lit(True).alias("_o")), on, "full_outer")
    return both.select(on, F.when(F.col("_o").isNull(), "defined-only").when(F.col("_d").isNull(), "observed-only").otherwise("both").alias("state"))


def added(new: DataFrame, old: DataFrame, strict: bool = True) -> DataFrame:
    """What a release adds, repeats counted. If the new release lost or changed a row of the old one, reading it fails."""
    signed = new.withColumn("_n", F.lit(1)).unionByName(old.withColumn("_n", F.lit(-1)))
    left = signed.groupBy(*new.columns).agg(F.sum("_n").alias("_n"))
    lost = F.raise_error(F.lit("not_additive: inherited rows are missing or changed")).cast("long") if strict else F.lit(0)
    counted = left.withColumn("_n", F.when(F.col("_n") < 0, lost).otherwise(F.col("_n"))).where("_n > 0")
    return counted.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def overlay(items: DataFrame, delta: DataFrame, on: str, column: str) -> DataFrame:
    """Set a column where it is null; values that are already there stay."""
    return items.join(delta.select(on, F.col(column).alias("_new")), on, "left").withColumn(column, F.coalesce(F.col(column), F.col("_new"))).drop("_new")


def overlay_conflicts(items: DataFrame, delta: DataFrame, on: str, column: str) -> DataFrame:
    """Rows of a delta that would change a value, or that name no item."""
    found = delta.select(on, F.col(column).alias("_new")).join(items.select(on, F.col(column).alias("_old"), F.lit(True).alias("_known")), on, "left")
    return found.where(F.col("_known").isNull() | (F.col("_old").isNotNull() & F.col("_new").isNotNull()))


def patched(items: DataFrame, excluded: DataFrame, patch: DataFrame, on: str, column: str) -> DataFrame:
    """Rows without the excluded ones, with patched values of a column."""
    kept = items.join(excluded, on, "left_anti").join(patch.select(on, F.col(column).alias("_new")), on, "left")
    return kept.withColumn(column, F.coalesce("_new", column)).drop("_new")


def unknown_overrides(items: DataFrame, excluded: DataFrame, patch: DataFrame, on: str) -> DataFrame:
    """(on, part): exclusions and patches that name no item; patched() is for overrides without any."""
    parts = [df.select(on, F.lit(name).alias("part")) for name, df in (("exclude", excluded), ("patch", patch))]
    return parts[0].unionByName(parts[1]).distinct().join(items.select(on), on, "left_anti")


def labelled(items: DataFrame, links: DataFrame) -> DataFrame:
    """(corpus, item_id, label, common): what each item's links say of it, null without any, and whether one has a target."""
    by = ["corpus", "item_id"]
    said = links.groupBy(*by).agg(F.collect_set("assessment").alias("_said"), F.max(F.col("target").isNotNull().cast("int")).alias("_common"))
    joined = items.select(*by).distinct().join(said, by, "left")
    return joined.select(*by, label(F.col("_said")).alias("label"), (F.coalesce("_common", F.lit(0)) > 0).alias("common"))


def schema_coverage(found: DataFrame) -> DataFrame:
    """(corpus, items, reviewed, common, unreviewed, pct) of labelled() items by corpus and, where corpus is null, of all."""
    n, reviewed = F.count("*"), F.count("label")
    pct = F.round(100 * reviewed / n, 2).alias("pct")
    return found.rollup("corpus").agg(n.alias("items"), reviewed.alias("reviewed"), F.sum(F.col("common").cast("long")).alias("common"), (n - reviewed).alias("unreviewed"), pct)


def holders_of_all(pairs: DataFrame, holder: str, wanted: DataFrame, on: str) -> DataFrame:
    """Holders that have every wanted value: relational division, with one count of the wanted."""
    n = wanted.select(on).distinct().count()
    kept = pairs.join(wanted.select(on).distinct(), on, "left_semi")
    return kept.groupBy(holder).agg(F.count_distinct(on).alias("n")).where(F.col("n") == n).select(holder)


def coverage_authorities(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items by corpus, and how many of them research and production reviewed, and with a target that is shared.

    `links` has (corpus, item_id, production, target): research counts them all.
    """
    by = ["corpus", "item_id"]
    seen = links.groupBy(*by).agg(F.count("target").alias("r"), F.sum(F.col("production").cast("int")).alias("_p"), F.count(F.when(F.col("production"), F.col("target"))).alias("_t"))
    seen = seen.select(*by, "r", F.when(F.col("_p") > 0, F.col("_t")).alias("p"))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    r, p = F.col("r"), F.col("p")
    return items.join(seen, by, "left").groupBy("corpus").agg(
        F.count("*").alias("items"), F.count("r").alias("research_reviewed"), one(r > 0).alias("research_common"), F.count("p").alias("production_reviewed"), one(p > 0).alias("production_common"), one(p.isNull()).alias("production_unreviewed")
    )


def assessment_histogram(items: DataFrame, links: DataFrame) -> DataFrame:
    """(corpus, assessment, n): how many items have each assessment, each item once."""
    return links.join(items, ["corpus", "item_id"], "left_semi").select("corpus", "item_id", "assessment").distinct().groupBy("corpus", "assessment").agg(F.count("*").alias("n"))


def split(links: DataFrame, denominator: DataFrame, on: list[str]) -> DataFrame:
    """(on, inside, assessments): accounted items, and whether the denominator has them."""
    per_item = links.groupBy(*on).agg(F.array_join(F.array_sort(F.collect_set("assessment")), "+").alias("assessments"))
    known = denominator.select(*on).distinct().withColumn("_known", F.lit(True))
    return per_item.join(known, on, "left").select(*on, F.col("_known").isNotNull().alias("inside"), "assessments")


def totals(items: DataFrame, column: str, counts: dict[str, Column]) -> DataFrame:
    """One row: items, those with a value, and one count for each condition."""
    one = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return items.agg(F.count("*").alias("items"), F.count(column).alias("reviewed"), *(one(c).alias(n) for n, c in counts.items()))


def structured(body: Column, marker: str, schema: str) -> Column:
    """The JSON document after a marker's line, read strictly; null without one."""
    found = F.regexp_extract(body, rf"(?s)(?:^|\n){marker}\n(.*)$", 1)
    return F.from_json(F.when(found != "", found), schema, {"mode": "FAILFAST"})
