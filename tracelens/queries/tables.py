"""How the driver's tables stand for calls, prompts, texts and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: an episode is a user's day, the event type is the tool, ``k`` its argument."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", F.col("event_type").alias("tool"), "value", F.get_json_object("props", "$.k").alias("k"))


EPISODE = ["user_id", "day"]
#: The same in SQL.
CALLS = "calls AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type AS tool, value, json_extract_string(props, '$.k') AS k FROM events)"
RUNS = (
    CALLS
    + """, marked AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN lag(tool) OVER w = tool THEN 0 ELSE 1 END AS new FROM calls WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
 isl AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY i) - 1 AS pos FROM marked),
 runs AS (SELECT user_id, day, CAST(pos AS BIGINT) AS pos, any_value(tool) AS token, min(i) AS start_idx, max(i) + 1 AS end_idx, count(*) > 1 AS fanout FROM isl GROUP BY user_id, day, pos)"""
)
