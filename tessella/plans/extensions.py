"""Extensions beyond the reference: windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import register
from tessella.sources.tables import table
from tessella.streaming import windows

DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2"


@register("tumbling_windows", DAYS)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"))


@register("streaming_windows", DAYS)
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_to_end(spark, sf_dir, "events").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("session_windows", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"))
