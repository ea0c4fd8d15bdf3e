"""Returned rows checked as they arrive: Structured Streaming over a folder of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokens import TOKEN_COLUMN, Sealer, open_column


def read_returns(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int = 16) -> DataFrame:
    """A stream of all-text rows from CSV files that land in a folder, with the time they came."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(schema).options(header=True, maxFilesPerTrigger=files_per_batch).csv(folder).withColumn("arrived", F.current_timestamp())


def opened(rows: DataFrame, sealer: Sealer) -> DataFrame:
    """rows with status and row_key of their token; duplicates are told by first_sightings."""
    out = rows.withColumn("_o", open_column(sealer)(F.col(TOKEN_COLUMN)))
    return out.withColumns({"status": F.col("_o.status"), "row_key": F.col("_o.row_key"), "table_no": F.col("_o.table_no")}).drop("_o")


def first_sightings(rows: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Verified rows, each reference once within the horizon; the state of older ones is dropped by the watermark."""
    good = rows.filter("status = 'verified'").withWatermark("arrived", horizon)
    return good.dropDuplicatesWithinWatermark(["table_no", "row_key"])


def status_counts(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, status, n) in tumbling windows; rows later than `late` are left out."""
    timed = rows.withWatermark("arrived", late)
    return timed.groupBy(F.window("arrived", window).alias("window"), "status").agg(F.count(F.lit(1)).alias("n"))


def start(rows: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream as Parquet; the checkpoint folder makes it exactly once."""
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
