"""Feature files: a header of @lines, a blank line, and a body of one value for a node, a range or a list of nodes.

Bodies are read by Spark as lines, in ranges of bytes, so a file of any size is many tasks. A line is `value`, for the
node after the last one, or `n<TAB>value`, `a-b<TAB>value`, `a,b-c<TAB>value`; values write tabs, line feeds and
backslashes as \\t, \\n and \\\\. Lines are numbered (chunk, pos): a chunk is a range of a file, and pos orders the lines
within it. Lines without a node need the lines before them: each chunk tells which node it names last and how many lines
follow that, and a sum over the chunks of a file says where each begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKERS = ("node", "edge", "config")
#: Lines of a chunk of a text that is a whole file in a row.
CHUNK = 65_536
#: A node, a range of nodes, or a list of these.
SPEC = r"^[0-9]{1,18}(-[0-9]{1,18})?(,[0-9]{1,18}(-[0-9]{1,18})?)*$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, chunk, pos, line) of files, read in ranges of bytes; a chunk is known by the byte that it begins with."""
    found = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    line = F.regexp_replace("value", "^\ufeff", "")
    return found.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("pos"), line.alias("line"))


def text_lines(rows: DataFrame, file: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """(file, chunk, pos, line) of texts that are whole feature files; positions begin with 0."""
    unix = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
    numbered = rows.select(F.col(file).alias("file"), F.posexplode(F.split(unix, "\n")).alias("pos", "line"))
    return numbered.select("file", F.floor(F.col("pos") / chunk).alias("chunk"), F.col("pos").cast("long").alias("pos"), "line")


def _starts(numbered: DataFrame) -> DataFrame:
    """(file, start, valued): the first blank line of each file, null without one, and whether its edges have values."""
    start = F.min(F.when(F.col("line") == "", F.struct("chunk", "pos")))
    return numbered.groupBy("file").agg(start.alias("start"), F.max(F.col("line") == "@edgeValues").alias("valued"))


def headers(numbered: DataFrame) -> DataFrame:
    """(file, marker, entries, problem): what kind of feature a file has, and its @key=value lines.

    Files of no one kind, edge values of other files, and keys that come twice are problems.
    """
    heads = numbered.where(F.col("line").startswith("@")).join(_starts(numbered), "file")
    head = heads.where(F.col("start").isNull() | (F.struct("chunk", "pos") < F.col("start")))
    key = F.regexp_extract("line", "^@([^=]*)", 1)
    value = F.regexp_extract("line", "^@[^=]*=(?s)(.*)$", 1)
    plain = ~F.contains("line", F.lit("="))
    kinds = F.collect_set(F.when(plain & key.isin(*MARKERS), key))
    keyed = F.when(~plain | (key == "edgeValues"), F.struct(key.alias("key"), value.alias("value")))
    found = head.groupBy("file").agg(kinds.alias("kinds"), F.collect_set(keyed).alias("pairs"), F.count(keyed).alias("n"))
    names = F.transform("pairs", lambda x: x["key"])
    twice = F.size(F.array_distinct(names)) < F.col("n")
    problem = F.when(F.size("kinds") != 1, "marker").when(F.array_contains(names, "edgeValues") & (F.get("kinds", F.lit(0)) != "edge"), "edge_values").when(twice, "key_twice")
    entries = F.when(~twice, F.map_from_entries("pairs"))
    return found.select("file", F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).alias("marker"), entries.alias("entries"), problem.alias("problem"))


def body(numbered: DataFrame) -> DataFrame:
    """(file, chunk, pos, line, valued): the lines after the blank one, without empty ones."""
    return numbered.where("line <> ''").join(_starts(numbered), "file").where(F.struct("chunk", "pos") > F.col("start")).drop("start")


def unescaped(value: Column) -> Column:
    """A value as it was before tabs, line feeds and backslashes were written as two characters."""
    kept = F.replace(value, F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(F.replace(kept, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))


def spec_ranges(spec: Column) -> Column:
    """The ranges of a node spec as an array of (first, last); null for what is no spec."""
    one = lambda x: F.struct(F.substring_index(x, "-", 1).cast("long").alias("first"), F.substring_index(x, "-", -1).cast("long").alias("last"))
    return F.when(spec.rlike(SPEC), F.transform(F.split(spec, ","), one))


def numbered_nodes(rows: DataFrame, given: str = "given") -> DataFrame:
    """Rows (file, chunk, pos, …) with `node`: the node that each line is about if it doesn't say so itself.

    `given` is the last node that a line names, or null. A line without one is about the node after that of the line
    before, 1 at a file's beginning. No task sees more than a chunk, or a row for each chunk of a file.
    """
    chunk = Window.partitionBy("file", "chunk")
    so_far = chunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumn("_anchor", F.last(given, ignorenulls=True).over(so_far)).withColumn("_run", F.count(given).over(so_far))
    since = Window.partitionBy("file", "chunk", "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("_since", F.sum(F.when(F.col(given).isNull(), 1).otherwise(0)).over(since))
    ends = named.groupBy("file", "chunk").agg(F.max_by(F.struct("_anchor", "_since"), "pos").alias("_end"))
    by_file = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_last", F.last("_end._anchor", ignorenulls=True).over(by_file)).withColumn("_group", F.count("_end._anchor").over(by_file))
    in_group = Window.partitionBy("file", "_group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_after", F.coalesce("_last", F.lit(0)) + F.sum("_end._since").over(in_group))
    carried = ends.select("file", "chunk", F.lag("_after", 1, 0).over(Window.partitionBy("file").orderBy("chunk")).alias("_carried"))
    node = F.coalesce("_anchor", "_carried") + F.col("_since")
    return named.join(carried, ["file", "chunk"]).withColumn("node", node.cast("long")).drop("_anchor", "_run", "_since", "_carried")


def ranges(numbered: DataFrame) -> DataFrame:
    """(file, first, last, value): the body's lines with the nodes that they are about; a list of nodes gives several rows."""
    tabbed = F.contains("line", F.lit("\t"))
    spec = F.when(tabbed, F.substring_index("line", "\t", 1))
    value = F.when(tabbed, F.regexp_extract("line", "^[^\t]*\t(?s)(.*)$", 1)).otherwise(F.col("line"))
    parsed = body(numbered).select("file", "chunk", "pos", unescaped(value).alias("value"), spec_ranges(spec).alias("ranges"))
    placed = numbered_nodes(parsed.withColumn("given", F.array_max(F.transform("ranges", lambda r: r["last"]))))
    own = F.array(F.struct(F.col("node").alias("first"), F.col("node").alias("last")))
    return placed.select("file", F.explode(F.coalesce("ranges", own)).alias("r"), "value").select("file", "r.first", "r.last", "value")


def malformed(numbered: DataFrame) -> DataFrame:
    """(file, line, problem): body lines that can't be read: specs that aren't nodes, and edges of too many fields."""
    known = body(numbered).join(headers(numbered).select("file", "marker"), "file")
    parts = F.split("line", "\t")
    n, edge = F.size(parts), F.col("marker") == "edge"
    most = F.when(F.col("valued"), 3).otherwise(2)
    is_spec = lambda k: F.coalesce(F.get(parts, k).rlike(SPEC), F.lit(False))
    of_edge = F.when(n > most, "fields").when(~is_spec(F.lit(0)) | ((n == most) & ~is_spec(F.lit(1))), "spec")
    problem = F.when(edge, of_edge).when((F.col("marker") == "node") & (n > 1) & ~is_spec(F.lit(0)), "spec")
    return known.select("file", "line", problem.alias("problem")).where("problem IS NOT NULL")


def type_counts(found: DataFrame) -> DataFrame:
    """(value, n) of ranges, without making their nodes."""
    return found.groupBy("value").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))


def nodes(found: DataFrame) -> DataFrame:
    """(file, node, value): every node of the ranges."""
    return found.select("file", F.explode(F.sequence("first", "last")).alias("node"), "value")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
