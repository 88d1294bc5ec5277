"""What several operators share: words, reliable lineage cuts and prefix sums."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that one Arrow batch may hold, so that a few long texts don't fill a Python worker.
ARROW_ROWS = 500


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Rows of a small table that one checkpoint file may hold.
FILE_ROWS = 200_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most `rows` short rows in no more partitions than they need."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def unsized(df: DataFrame) -> DataFrame:
    """The same rows as a table of unknown size, for loops of joins.

    A checkpoint keeps the planner's estimate of its size, and each join multiplies those of its sides: after some rounds
    the planner would do nothing but multiply numbers of millions of digits.
    """
    return df.sparkSession.createDataFrame(df.rdd, df.schema, verifySchema=False)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    A folder is set here only where none is configured, as in tests on one machine. Where the number of rows is
    known to be at most `rows`, there are no more files than they need: a process starts for each file.
    """
    if rows is not None:
        df = few(df, rows)
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder from the session, or, on one machine alone, a temporary one where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch by the session setting; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
