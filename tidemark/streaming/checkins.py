"""Check-ins as a stream: counts and social scores kept up to date by the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_checkin_stream(spark: SparkSession, path: str) -> DataFrame:
    """(p, u, cnt) from Parquet files as they arrive."""
    return spark.readStream.schema("p long, u long, cnt long").parquet(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """(p, visits, visitors): for outputMode("complete") or ("update"); visitors is an estimate, as an exact one would
    hold every visitor in state."""
    return stream.groupBy("p").agg(F.sum("cnt").alias("visits"), F.approx_count_distinct("u").alias("visitors"))


def upsert_to(path: str):
    """For foreachBatch: each batch's check-ins appended under its number, so that a batch that runs twice is written
    once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
