"""The event table as a stream: an extension, as text graphs themselves don't stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossgraph.session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive: files of the table's schema."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n) by tumbling windows; events later than `late` behind the newest are dropped."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream's query to its end and read its result, which is written as Parquet in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/drained_{uuid.uuid4().hex}"
    written = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result-{number}")
        written.append(f"{folder}/result-{number}")

    run = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if not written:
        return spark.createDataFrame([], df.schema)
    # in complete mode each batch has the whole result
    return spark.read.schema(df.schema).parquet(*(written[-1:] if mode == "complete" else written))


def event_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, n, users), over the table read as a stream."""
    counted = event_stream(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("k"))
    return drain(counted).groupBy("event_type").agg(F.sum("k").alias("n"), F.count("*").alias("users"))
