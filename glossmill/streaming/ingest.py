"""Streams of documents: rank each arriving document; count terms in windows of event time.

A document is a unit of work of its own, so ranking a stream is the batch plan applied to each
micro-batch. Late documents beyond the watermark are left out of the windows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def token_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_terms(tokens: DataFrame, delay: str = "30 days", window: str = "7 days", field: str = "lemma") -> DataFrame:
    """(window, term, n): rows per term and window of arrival; null and empty terms are left out."""
    live = tokens.withWatermark("loaded_at", delay).where(F.col(field).isNotNull() & (F.col(field) != ""))
    return live.groupBy(F.window("loaded_at", window), F.col(field).alias("term")).agg(F.count("*").alias("n"))


def rank_stream(tokens: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of tokens through a batch plan, its result appended with the batch's number.

    A batch that is run again after a failure overwrites its own folder, so results come once.
    """
    def write(batch: DataFrame, number: int) -> None:
        plan(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tokens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
