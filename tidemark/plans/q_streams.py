"""Streaming queries: the events table as a stream, drained with availableNow into Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..streaming import windows as W
from . import binding as B
from .registry import query


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = B.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drain(result: DataFrame, mode: str) -> DataFrame:
    """Run a streaming result to its end, into Parquet in the shared folder: appended, or the last batch's complete result."""
    spark = result.sparkSession
    path = scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        target = f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(target)  # a batch that is run again replaces itself

    running = result.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


@query("x02_sliding_state", "SELECT d AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 13 DAY, date_trunc('day', ts), INTERVAL 1 DAY))::DATE AS d FROM events) GROUP BY ALL")
def x02_sliding_state(spark, sf_dir):
    """Also X1, late rows by watermark."""
    out = drain(W.sliding_state(events_stream(spark, sf_dir)), "complete")
    return out.select(F.col("window.start").cast("date").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("x03_tumbling_periods", "SELECT time_bucket(INTERVAL 21 DAY, ts, TIMESTAMP '1970-01-01')::DATE AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x03_tumbling_periods(spark, sf_dir):
    out = drain(W.tumbling_periods(events_stream(spark, sf_dir)), "complete")
    return out.select(F.col("window.start").cast("date").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("x04_sessions", "SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s")
def x04_sessions(spark, sf_dir):
    out = drain(W.sessions(events_stream(spark, sf_dir)), "complete")
    return out.select("user_id", "n", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"))


@query("x04_greedy_clusters")
def x04_greedy_clusters(spark, sf_dir):
    """Stateful clusters per user; tests compare them with the batch operator."""
    timed = W.with_event_time(events_stream(spark, sf_dir), "ts", "1 day")
    clusters = W.greedy_clusters(timed.withColumn("owner", F.hash("event_type").cast("long")), key="user_id", owner="owner", column="ts", days=2)
    return drain(clusters, "append")


@query("x06_deduplicated", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def x06_deduplicated(spark, sf_dir):
    out = drain(W.deduplicated(events_stream(spark, sf_dir)).select("event_id", "event_type"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))
