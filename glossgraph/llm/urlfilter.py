"""URL filters: explicit rules first, then a path-template tree with smoothed labelled purity.

Rules name a host with its subdomains and a beginning of the path; the longest rule that fits decides, and of
equally long ones the last by code point. Rules are a table: hosts meet them by an equi-join on their suffixes,
so lists of any length will do. Other addresses are judged by the template of their path. Within each host,
paths form a tree. Digits in a segment are a wildcard, written {n}, from the start; a star or brace that stands
in an address is written {* or {{, so it's never taken for a wildcard. Level by level, all children of a node become one wildcard where there are many
children and few addresses for each (names, ids, dates), and otherwise those children whose labelled share
can't be told from that of their siblings are merged into one. A template is rejected where its bad share among
labelled addresses, smoothed by its host's and that by the whole table's, reaches a threshold.

All steps are grouped sums and equi-joins on (host, path so far, segment); an address that is very common is
summed up before any shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossgraph.llm.common import cut

#: A node's children are variable if there are at least MANY, with fewer than FEW_EACH addresses for each.
MANY = 8
FEW_EACH = 4.0
#: Standard errors by which a child's bad share must differ from its siblings' to stay a branch of its own.
APART = 2.0
#: Labelled addresses that the level above counts as.
STRENGTH = 5.0
REJECT = 0.5
WILD = "*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`allow` or `block` for a host, its subdomains, and paths that begin with the rule's."""

    verdict: str
    text: str

    @property
    def parts(self) -> tuple[str, str]:
        """Host, and path with its slash."""
        host, slash, path = self.text.partition("/")
        return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


RULE = "struct<host:string,path:string,rule:string,verdict:string>"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (host, path, rule, verdict): the rules as a table of one literal."""
    rows = [dict(zip(("host", "path", "rule", "verdict"), (*r.parts, r.text, r.verdict), strict=True)) for r in rules]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<{RULE}>")))


def host_rules(hosts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (host, rules): for each host with any, its rules, the longest first.

    A rule's host equals one of the host's suffixes of as many labels, so suffixes longer than the longest rule's
    aren't made.
    """
    table = rule_table(hosts.sparkSession, rules)
    labels = max((r.parts[0].count(".") + 1 for r in rules), default=1)
    suffixes = F.expr(f"array_distinct(transform(sequence(1, {labels}), k -> substring_index(host, '.', -k)))")
    found = hosts.select("host").distinct().select(F.col("host").alias("of"), F.explode(suffixes).alias("host")).join(table, "host")
    entry = F.struct((-F.length("rule")).alias("shorter"), "rule", "path", "verdict")
    longest_first = lambda a, b: F.when(a["shorter"] != b["shorter"], a["shorter"] - b["shorter"]).when(a["rule"] > b["rule"], -1).when(a["rule"] < b["rule"], 1).otherwise(0)
    return found.groupBy(F.col("of").alias("host")).agg(F.array_sort(F.collect_list(entry), longest_first).alias("rules"))


def ruled(path: Column, rules: Column) -> tuple[Column, Column]:
    """The first rule of a host's list that fits the path, and its verdict; null where none fits."""
    first = F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))
    return first["rule"], first["verdict"]


def segments(path: Column) -> Column:
    """The path's segments with digits as a wildcard; literal braces and stars are escaped."""
    escaped = F.replace(F.replace(F.regexp_replace(path, "^/", ""), F.lit("{"), F.lit("{{")), F.lit("*"), F.lit("{*"))
    return F.split(F.regexp_replace(escaped, "[0-9]+", "{n}"), "/")


def _past_common(state: DataFrame) -> DataFrame:
    """Move each node's addresses past the segments that all of them share: a lone branch keeps its name."""
    ends = state.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    # what the first and the last in order share, all share
    differs = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
    shared = ends.select("host", "template", F.when(differs > 0, differs - 1).otherwise(F.size("low")).cast("int").alias("shared"))
    moved = state.join(shared, ["host", "template"])
    begin, rest = F.slice("rest", F.lit(1), F.col("shared")), F.slice("rest", F.col("shared") + 1, F.size("rest"))
    return moved.select("host", "shape", F.concat_ws("/", "template", begin).alias("template"), rest.alias("rest"), "n", "labelled", "bad")


def templates(addresses: DataFrame) -> DataFrame:
    """Rows (host, shape, template, n, labelled, bad) from (host, shape, n, labelled, bad), one for each shape.

    Goes on until no path has a further segment. Each turn takes every open node to its next fork and through it.
    """
    sums = lambda: [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    state = cut(addresses.withColumns({"template": F.lit(""), "rest": F.col("shape")}))
    rows, columns = state.count(), ["host", "shape", "template", "n", "labelled", "bad"]
    done = state.where(F.size("rest") == 0).select(*columns)
    while True:
        state = cut(_past_common(state.where(F.size("rest") > 0)), rows)
        done = done.unionAll(state.where(F.size("rest") == 0).select(*columns))
        state = state.where(F.size("rest") > 0)
        if state.isEmpty():
            return done
        state = state.withColumn("segment", F.get("rest", F.lit(0)))
        children = state.groupBy("host", "template", "segment").agg(*sums())
        parents = children.groupBy("host", "template").agg(F.count("*").alias("many"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")))
        others, other_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share, other = (F.col("bad") + 1) / (F.col("labelled") + 2), (other_bad + 1) / (others + 2)
        error = F.sqrt(share * (1 - share) / (F.col("labelled") + 2) + other * (1 - other) / (others + 2))
        variable = (F.col("many") >= MANY) & (F.col("all_n") < F.col("many") * FEW_EACH)
        apart = F.abs(share - other) >= APART * error
        marked = children.join(parents, ["host", "template"]).select("host", "template", "segment", variable.alias("variable"), apart.alias("apart"))
        alike = marked.where(~F.col("apart")).groupBy("host", "template").agg(F.count("*").alias("alike"))
        # a branch that is like no other isn't merged
        merges = F.col("variable") | (~F.col("apart") & (F.col("alike") > 1))
        decided = marked.join(alike, ["host", "template"], "left").select("host", "template", "segment", F.when(merges, WILD).otherwise(F.col("segment")).alias("branch"))
        state = state.join(decided, ["host", "template", "segment"]).withColumns({"template": F.concat_ws("/", "template", "branch"), "rest": F.slice("rest", F.lit(2), F.size("rest"))})
        state = cut(state.select(*columns, "rest"), rows)  # each turn reads it twice
        done = done.unionAll(state.where(F.size("rest") == 0).select(*columns))


def purity(leaves: DataFrame) -> DataFrame:
    """Rows (host, template, bad_share): smoothed by the host's share, and that by the table's."""
    by_template = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    whole = by_host.agg(F.sum("host_labelled").alias("labelled"), F.sum("host_bad").alias("bad")).first()
    base = (whole.bad + 1.0) / (whole.labelled + 2.0) if whole.labelled else 0.0  # without a label nothing is rejected
    host_share = (F.col("host_bad") + STRENGTH * base) / (F.col("host_labelled") + STRENGTH)
    return by_template.join(by_host, "host").select(
        "host", "template", ((F.col("bad") + STRENGTH * host_share) / (F.col("labelled") + STRENGTH)).alias("bad_share")
    )


def judge(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", bad: str = "bad", reject: float = REJECT) -> DataFrame:
    """Add host, path, rule, template, bad_share and verdict; `bad` is a label of 0 or 1, null without one.

    Null addresses and those without `://` have empty host and path and share a template. Repeated rows are
    judged alike, and so are ties. An empty table stays empty. Input columns of these names, and those that begin
    with _url_, are replaced; addresses of any length are read whole.
    """
    host, path = parse(F.col(url))
    made = ["host", "path", "rule", "template", "bad_share", "verdict", "_url_shape", "_url_rules"]
    parsed = pages.drop(*made).withColumns({"host": host, "path": path})
    parsed = parsed.withColumn("_url_shape", segments(F.col("path")))
    counted = parsed.groupBy("host", F.col("_url_shape").alias("shape")).agg(
        F.count("*").alias("n"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad")
    )
    leaves = templates(counted)
    # one row for each host and shape, so the pages are joined once
    judged = leaves.select("host", F.col("shape").alias("_url_shape"), "template").join(purity(leaves), ["host", "template"])
    judged = judged.join(host_rules(judged, rules).withColumnRenamed("rules", "_url_rules"), "host", "left")
    rule, verdict = ruled(F.col("path"), F.col("_url_rules"))
    by_method = F.when(F.col("bad_share") >= reject, "block").otherwise("allow")
    joined = parsed.join(judged, ["host", "_url_shape"]).withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_method)})
    return joined.drop("_url_shape", "_url_rules")
