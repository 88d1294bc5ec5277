"""A training-data pipeline in stages; each stage works on all documents that its predecessor kept.

Stages take and return documents (doc_id, text, lang, source, n_chars), but for the last, which returns the
pieces of packed sequences. Each stage's result is written as Parquet and read again by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossgraph.llm import mixing, packing, pii, simhash, toxicity
from glossgraph.llm.common import checkpoint_dir, cut, n_words

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; the model is fitted on labelled documents of this input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("grade", toxicity.given_grade()))
    return toxicity.score(docs, model).where(~F.col("toxicity.rejected")).select(*docs.columns)


#: Least share of five-word shingles that near copies have in common.
SIMILAR = 0.8


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id, a null id before all others.

    Copies are found by SimHash fingerprints and their byte-position index, then by minima of shingles where texts
    differ in more bits; both are confirmed by their shingles.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    keyed = docs.withColumn("_key", key)
    found = simhash.near_copies(keyed, "_key", least=SIMILAR)
    least = found.groupBy("component").agg(F.min(F.struct("doc_id", "print")).alias("least"))
    first = least.select(F.col("least.doc_id").alias("_key"), F.col("least.print").alias("_print"))
    # rows that share an id may have different texts, so a row is known by its id and its text
    printed = keyed.withColumn("_print", simhash.text_print(F.col("text")))
    return printed.join(first, ["_key", "_print"], "left_semi").dropDuplicates(["_key", "_print"]).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars follows the text."""
    masked = pii.find(docs).withColumn("text", pii.masked(F.col("text"), F.col("pii"))).drop("pii")
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as systematic sampling emits them; copies are rows alike."""
    sized = docs.withColumn("_size", n_words(F.col("text")))
    mixed = mixing.emit(mixing.mix(sized, "_size"))
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their sequence and their place in it."""
    return packing.pack(cut(packing.pieces(docs, packing.tokenizer_path())))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: No stage can be written in SQL as a whole: a model is fitted, fingerprints are linked and texts are tokenized.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
