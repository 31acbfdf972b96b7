"""Queries on the file-event stream: the debounce over a batch, with SQL, and as a stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.session import own_dir
from marrow.plans.tables import table
from marrow.sources.state import watch_config
from marrow.streaming import watch

GAP = "6 hours"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("/src/u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("ts"))


def _plain(df: DataFrame) -> DataFrame:
    return df.select("path", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n", "op")


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(watch.debounced(_events(spark, sf_dir), GAP))


def watch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per rule: of two rules that match, the later one counts."""
    config = watch_config({"rules": [{"sources": ["/src"]}, {"sources": ["/src"], "patterns": ["u1*.md"], "strategy": "patch", "debounce": "2s"}]}, "/")
    events = _events(spark, sf_dir).withColumn("op", F.lit("write"))
    got = watch.matched(events, config).withColumn("target", watch.target_column(config, F.col("path"), F.col("rule")))
    return got.groupBy("target", "rule", "debounce_ms").agg(F.count("*").alias("n"))


def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same debounce as a stream over the events, run until all is read; bursts open at the end stay open."""
    where = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a stream reads a folder: the table is a file or a folder of parts
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{where}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{where}/events")
    rows = stream.select(F.concat(F.lit("/src/u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("ts"))
    # files of a table come in no order of time: the watermark waits for the longest span among them
    bursts = watch.debounced(rows, GAP, watermark="1 day")
    query = bursts.writeStream.format("parquet").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start(f"{where}/out")
    query.awaitTermination()
    return _plain(spark.read.schema(bursts.schema).parquet(f"{where}/out"))


def debounce_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each path by each rule that matches it, the rules waiting six hours and one."""
    config = watch_config({"rules": [{"sources": ["/src"], "debounce": "6h"}, {"sources": ["/src"], "patterns": ["u1*.md"], "debounce": "1h"}]}, "/")
    rows = watch.matched(_events(spark, sf_dir).withColumn("op", F.lit("write")), config, every_rule=True)
    return watch.debounced(rows, watch.rule_gap(), keys=("path", "rule")).groupBy("path", "rule").agg(F.count("*").alias("bursts"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (debounce_sessions, watch_matches, debounce_stream, debounce_rules)}

_BURSTS = """
WITH e AS (SELECT '/src/u' || user_id || '.md' AS path, ts, event_type AS op FROM events),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM e),
s AS (SELECT *, sum(begins) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM b)
SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, arg_max(op, ts) AS op FROM s GROUP BY path, burst"""

SQL = {
    "debounce_rules": """
WITH e AS (SELECT '/src/u' || user_id || '.md' AS path, ts, 0 AS rule, INTERVAL 6 HOUR AS gap FROM events UNION ALL SELECT '/src/u' || user_id || '.md', ts, 1, INTERVAL 1 HOUR FROM events WHERE starts_with(user_id::VARCHAR, '1')),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path, rule ORDER BY ts) <= gap THEN 0 ELSE 1 END AS begins FROM e)
SELECT path, rule, sum(begins)::BIGINT AS bursts, count(*) AS n FROM b GROUP BY path, rule""",
    "debounce_sessions": _BURSTS,
    # a burst is told once its quiet time ends before the watermark, a day behind the last event
    "debounce_stream": _BURSTS + " HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "watch_matches": """
SELECT 'u' || user_id || '.md' AS target, CASE WHEN starts_with(user_id::VARCHAR, '1') THEN 1 ELSE 0 END AS rule, CASE WHEN starts_with(user_id::VARCHAR, '1') THEN 2000 ELSE 300 END AS debounce_ms, count(*) AS n
FROM events GROUP BY 1, 2, 3""",
}
