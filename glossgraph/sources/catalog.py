"""Mapping catalogs: which native selectors of a corpus express which category.

A catalog is a DataFrame of MAPPING columns, all strings. It is read from XML documents, one for each corpus,
or derived from tables. Rules that rows must keep are queries for violations; a catalog is sound if they are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The catalog's vocabulary.
KINDS = ("node", "feature", "value", "edge", "entity")
EXACT = ("exact",)
APPROXIMATE = ("close", "broader", "narrower", "related")
UNMATCHED = ("ambiguous", "native-only", "unsupported")
RELATIONS = EXACT + APPROXIMATE + UNMATCHED
SELECTOR = ("kind", "node", "feature", "value", "from_node", "to_node")
MAPPING = ("corpus", "source", "corpus_version", *SELECTOR[:1], "relation", "target", *SELECTOR[1:], "evidence", "note")
#: Selector fields that a kind must have; it has no others.
REQUIRED = {"node": ("node",), "feature": ("feature",), "value": ("node", "feature", "value"), "edge": ("feature",), "entity": ("node", "feature", "value")}
OPTIONAL = {"node": ("feature",), "feature": ("node",), "edge": ("from_node", "to_node")}

XML_ROW = T.StructType(
    [T.StructField(f"_{c}", T.StringType()) for c in ("kind", "relation", "target", "node", "feature", "value", "from", "to", "evidence", "note", "corpusVersion")]
    + [T.StructField("body", T.StringType())]
)
XML_ROOT = T.StructType([T.StructField(f"_{c}", T.StringType()) for c in ("corpus", "source", "corpusVersion")])


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `<mappings corpus source corpusVersion><map .../></mappings>` documents under a path.

    Attributes of the root are joined to its rows by the file's name, so each corpus is one file.
    """
    name = F.input_file_name()
    rows = spark.read.format("xml").option("rowTag", "map").option("valueTag", "body").schema(XML_ROW).load(path).withColumn("file", name)
    roots = spark.read.format("xml").option("rowTag", "mappings").schema(XML_ROOT).load(path).withColumn("file", name)
    renamed = rows.select("file", *(F.col(f"_{c}").alias({"from": "from_node", "to": "to_node"}.get(c, c)) for c in ("kind", "relation", "target", "node", "feature", "value", "from", "to", "evidence", "note")), F.col("_corpusVersion").alias("row_version"))
    heads = roots.select("file", F.col("_corpus").alias("corpus"), F.col("_source").alias("source"), F.col("_corpusVersion").alias("corpus_version"))
    # a row's own version comes before its document's
    return renamed.join(heads, "file").withColumn("corpus_version", F.coalesce("row_version", "corpus_version")).select(*MAPPING)


def unknown_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(file, attribute): attributes of rows that the format doesn't know."""
    rows = spark.read.format("xml").option("rowTag", "map").option("valueTag", "body").load(path)
    extra = sorted(set(rows.columns) - {f.name for f in XML_ROW} - {"body"})
    if not extra:
        return spark.createDataFrame([], "file string, attribute string")
    pairs = F.array(*(F.struct(F.lit(c.removeprefix("_")).alias("attribute"), F.col(f"`{c}`").isNotNull().alias("there")) for c in extra))
    return rows.select(F.input_file_name().alias("file"), F.inline(pairs)).where("there").select("file", "attribute").distinct()


def misnamed(spark: SparkSession, path: str) -> DataFrame:
    """(file, corpus): documents whose corpus isn't their file's name."""
    roots = spark.read.format("xml").option("rowTag", "mappings").schema(XML_ROOT).load(path).select(F.input_file_name().alias("file"), F.col("_corpus").alias("corpus"))
    return roots.where(~F.regexp_extract("file", r"([^/]+)\.xml$", 1).eqNullSafe(F.col("corpus")))


def load(spark: SparkSession, folder: str, corpus: str) -> DataFrame:
    """The rows of one corpus: only its own document is read, so a broken one elsewhere does no harm."""
    return read_xml(spark, f"{folder}/{corpus}.xml")


def corpora(mappings: DataFrame) -> DataFrame:
    """Corpora in order."""
    return mappings.select("corpus").distinct().orderBy("corpus")


def is_iri(c: Column) -> Column:
    """A scheme, a colon and something after it."""
    return c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:.+")


def row_violations(mappings: DataFrame) -> DataFrame:
    """Rows with what is wrong with them: vocabulary, selector fields, and targets that their relation needs or forbids."""
    known = F.col("kind").isin(*KINDS)
    fields = F.lit(False)
    for kind in KINDS:
        need, may = REQUIRED[kind], OPTIONAL.get(kind, ())
        lacks = [F.col(c).isNull() | (F.trim(c) == "") for c in need] + [F.coalesce(F.trim(c) == "", F.lit(False)) for c in may]
        extra = [F.col(c).isNotNull() for c in SELECTOR[1:] if c not in need + may]
        wrong = F.lit(False)
        for condition in lacks + extra:
            wrong = wrong | condition
        fields = F.when(F.col("kind") == kind, wrong).otherwise(fields)
    targeted = F.col("relation").isin(*EXACT, *APPROXIMATE)
    problem = (
        F.when(~known, "kind")
        .when(~F.col("relation").isin(*RELATIONS), "relation")
        .when(fields, "selector")
        .when(targeted & ~F.coalesce(is_iri(F.col("target")), F.lit(False)), "target_missing")
        .when(F.col("relation").isin("native-only", "unsupported") & F.col("target").isNotNull(), "target_forbidden")
        .when((F.col("relation") == "ambiguous") & F.col("target").isNotNull() & ~is_iri(F.col("target")), "target_invalid")
    )
    return mappings.withColumn("problem", problem).where(F.col("problem").isNotNull())


def _key() -> Column:
    """A selector as one string; null fields differ from empty ones."""
    return F.to_json(F.struct(*SELECTOR))


def duplicates(mappings: DataFrame) -> DataFrame:
    """Rows said twice: one corpus, version, selector, relation and target."""
    by = ["corpus", "corpus_version", *SELECTOR, "relation", "target"]
    return mappings.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(mappings: DataFrame) -> DataFrame:
    """Selectors with dispositions that exclude each other: (corpus, selector, a, b).

    Two rows for one selector conflict if their versions are equal or one has none, one of them at least has no
    match, and they aren't both ambiguous. Rows of one selector meet by an equi-join on it.
    """
    rows = mappings.select("corpus", "corpus_version", "relation", _key().alias("selector")).distinct()
    a, b = rows.alias("a"), rows.alias("b")
    unmatched = lambda s: F.col(f"{s}.relation").isin(*UNMATCHED)
    same = (F.col("a.corpus") == F.col("b.corpus")) & (F.col("a.selector") == F.col("b.selector"))
    versions = F.col("a.corpus_version").isNull() | F.col("b.corpus_version").isNull() | (F.col("a.corpus_version") == F.col("b.corpus_version"))
    rank = lambda s: F.struct(f"{s}.relation", F.coalesce(f"{s}.corpus_version", F.lit("")))
    both_open = (F.col("a.relation") == "ambiguous") & (F.col("b.relation") == "ambiguous")
    hit = a.join(b, same & versions & (rank("a") < rank("b")) & (unmatched("a") | unmatched("b")) & ~both_open)
    return hit.select("a.corpus", "a.selector", F.col("a.relation").alias("a"), F.col("b.relation").alias("b")).distinct()


def latest(versions: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The highest of dotted versions for each key, compared number by number."""
    numbers = F.transform(F.split(column, r"\."), lambda x: x.cast("int"))
    order = Window.partitionBy(*by).orderBy(numbers.desc())
    return versions.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
