"""Changes of catalogs: proposals, decisions, overlays and supersessions as joins; each previews what a release would have.

Signing, hosting and fetching of reviews aren't data and aren't here. What a change may not do is a table of problems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.functions.digests import row_digest
from glossgraph.operators.ordering import last_two, latest

#: Decisions in one proposal, and transitions in one supersession, at most.
MOST = 50


def proposals(decisions: DataFrame, evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """(mapping_id, target, evidence_digest, problem): candidate mappings from decisions (mapping_id, target, evidence_id).

    A decision without its evidence or whose target no ontology has is kept with its problem.
    """
    joined = decisions.join(evidence.select("evidence_id", F.col("content_digest").alias("evidence_digest")), "evidence_id", "left")
    joined = joined.join(terms.select(F.col("term").alias("target")).distinct().withColumn("_known", F.lit(True)), "target", "left")
    problem = F.when(F.col("evidence_digest").isNull(), "missing_evidence").when(F.col("_known").isNull(), "unknown_target")
    return joined.select("mapping_id", "target", "evidence_digest", problem.alias("problem"))


def batches(decisions: DataFrame, by: str, most: int = MOST) -> DataFrame:
    """(by, n, problem): how many decisions each proposal has; more than `most` are refused, as are repeated mappings."""
    counted = decisions.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("mapping_id").alias("_distinct"))
    return counted.select(by, "n", F.when(F.col("n") > most, "batch_too_large").when(F.col("n") > F.col("_distinct"), "duplicate_mapping").alias("problem"))


def packet(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """Candidates with the digest of their fields: what a review commits to."""
    return candidates.withColumn("commitment", row_digest({f: F.col(f) for f in fields}))


def parity(rebuilt: DataFrame, released: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """(on, state): rows that rebuilding doesn't give as they were released: missing, added or changed."""
    digest = row_digest({f: F.col(f) for f in fields})
    both = rebuilt.select(on, digest.alias("_new")).join(released.select(on, digest.alias("_old")), on, "full_outer")
    state = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "added").when(F.col("_new") != F.col("_old"), "changed")
    return both.select(on, state.alias("state")).where("state IS NOT NULL")


def decided(reviews: DataFrame, item: str, reviewer: Column, author: Column | None = None, least: int = 2) -> DataFrame:
    """(item, reviewers, status): what reviews (item, reviewer, state, ts, id) come to.

    Of each reviewer the last decision counts, pending ones aside, so a later one revokes. Authors don't review their own
    items. At least `least` reviewers must agree.
    """
    counted = reviews.where("state <> 'pending'").withColumn("_reviewer", F.lower(reviewer))
    if author is not None:
        counted = counted.where(~F.col("_reviewer").eqNullSafe(F.lower(author)))
    last = latest(counted, [item, "_reviewer"], "ts", "id")
    n, states = F.count("*"), F.count_distinct("state")
    status = F.when(n < least, "incomplete").when(states > 1, "disputed").otherwise(F.max("state"))
    return last.groupBy(item).agg(n.alias("reviewers"), status.alias("status"))


def two_passes(reviews: DataFrame, item: str) -> DataFrame:
    """(item, first, second, status) of the last two reviews of each item, pending ones aside: both must accept."""
    kept = last_two(reviews.where("state <> 'pending'"), [item], "ts", "id")
    at = lambda k: F.max(F.when(F.col("position") == k, F.col("state")))
    pair = kept.groupBy(item).agg(F.count("*").alias("_n"), at(1).alias("_last"), at(2).alias("_before"))
    alone = F.col("_n") < 2
    status = F.when(alone, "incomplete").when((F.col("_before") == "accept") & (F.col("_last") == "accept"), "accept").otherwise("reject")
    return pair.select(item, F.when(alone, F.col("_last")).otherwise(F.col("_before")).alias("first"), F.when(~alone, F.col("_last")).alias("second"), status.alias("status"))


def handoff(accepted: DataFrame, inherited: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Accepted rows with the first of `keys` by which a release already has them; null in `taken` for new ones."""
    out = accepted
    for key in keys:
        out = out.join(inherited.select(key).distinct().withColumn(f"_{key}", F.lit(key)), key, "left")
    taken = F.coalesce(*(F.col(f"_{k}") for k in keys))
    return out.withColumn("taken", taken).drop(*(f"_{k}" for k in keys))


def supersede(active: DataFrame, transitions: DataFrame) -> DataFrame:
    """(mapping_id, native_state, target, action): active rows after transitions (mapping_id, new_id, target).

    A row that was native-only is retired and its successor takes its place; rows of another state can't be
    superseded, and keep theirs. Others stay.
    """
    joined = active.join(transitions.select("mapping_id", "new_id", F.col("target").alias("_target")), "mapping_id", "left")
    moves, legal = F.col("new_id").isNotNull(), F.col("native_state") == "native-only"
    old = F.struct(F.col("mapping_id").alias("mapping_id"), F.col("native_state").alias("native_state"), F.lit(None).cast("string").alias("target"), F.when(moves & legal, "retired").when(moves, "refused").otherwise("kept").alias("action"))
    new = F.struct(F.col("new_id").alias("mapping_id"), F.lit("positive").alias("native_state"), F.col("_target").alias("target"), F.lit("added").alias("action"))
    return joined.select(F.inline(F.when(moves & legal, F.array(old, new)).otherwise(F.array(old))))


def transition_problems(transitions: DataFrame, keys: tuple[str, ...], by: str | None = None) -> DataFrame:
    """(key, value, n): values that transitions (of one batch, if `by` is given) have more than once though each must be unique."""
    pairs = transitions.select(*([by] if by else []), F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))))
    return pairs.groupBy(*([by] if by else []), "key", "value").agg(F.count("*").alias("n")).where("n > 1")


def shadowed(new: DataFrame, installed: DataFrame, on: str, digest: str) -> DataFrame:
    """New evidence under an installed id with another digest: it may add, and never replace."""
    old = installed.select(on, F.col(digest).alias("_installed"))
    return new.join(old, on).where(~F.col(digest).eqNullSafe(F.col("_installed"))).select(on)


def merged(new: DataFrame, installed: DataFrame, on: str) -> DataFrame:
    """Installed evidence, and what is new beside it."""
    return installed.unionByName(new.select(*installed.columns).join(installed.select(on), on, "left_anti"))


def successor(items: DataFrame, family: Column, column: str, value: Column) -> DataFrame:
    """Items where those of one family get a value if they have none; `changed` says which did."""
    takes = F.col(column).isNull() & F.coalesce(family, F.lit(False))
    return items.withColumn("changed", takes).withColumn(column, F.when(takes, value).otherwise(F.col(column)))


def successor_problems(old: DataFrame, new: DataFrame, on: str, column: str) -> DataFrame:
    """(on, problem): items that a successor lost, added, or changed though they had a value."""
    both = old.select(on, F.col(column).alias("_old"), F.lit(1).alias("_o")).join(new.select(on, F.col(column).alias("_new"), F.lit(1).alias("_n")), on, "full_outer")
    problem = F.when(F.col("_n").isNull(), "lost").when(F.col("_o").isNull(), "added").when(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(on, problem.alias("problem")).where("problem IS NOT NULL")
