"""Structured Streaming over event files. An extension: nothing that is ported here streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.graph import shared_folder


def tumbling(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums in cents by window and type; a batch or a stream, on a stream with late rows up to a watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    cents = F.round(F.col("value") * 100).cast("long")
    rows = events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user, closed by a gap."""
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def run_to_end(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read a table's file as a stream, aggregate it and give what the query has when the input is used up."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).schema
    raw = spark.readStream.schema(spark.read.parquet(path).schema).format("parquet").option("pathGlobFilter", f"{name}.parquet").load(folder)
    stream = raw.withColumn("ts", F.col("ts").cast(schema["ts"].dataType))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    result = tumbling(stream)
    # the result of the last batch is the whole one; it is written by the executors and not gathered
    query = result.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/result")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/result")
