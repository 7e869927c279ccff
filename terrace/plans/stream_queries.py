"""Queries that run as streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.projections import table
from ..sources.scratch import shared_path
from ..streaming import windows
from .catalogue import Catalogue

cat = Catalogue()


def _stream(spark, sf_dir) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")


@cat.add("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    path = shared_path(spark, "windows")
    windows.run_to_table(windows.counts_by_window(_stream(spark, sf_dir)), path)
    return windows.result_of(spark, path).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@cat.add("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", "n")


@cat.add("""SELECT CAST(floor(event_id/2.0e3) AS INT) AS game, event_id AS seq, coalesce(last_value(CASE event_type WHEN 'signup' THEN '' WHEN 'view' THEN NULL ELSE CASE WHEN user_id%20<10 THEN 'home' ELSE 'away' END END IGNORE NULLS)
 OVER (PARTITION BY floor(event_id/2.0e3) ORDER BY event_id ROWS UNBOUNDED PRECEDING),'') AS holder FROM events""")
def stream_possession(spark, sf_dir):
    path = shared_path(spark, "possession")
    kind = F.when(F.col("event_type") == "signup", "BALL OUT").when(F.col("event_type") == "view", "CHALLENGE").otherwise("PASS")
    rows = _stream(spark, sf_dir).select(F.floor(F.col("event_id") / 2000).cast("int").alias("game"), F.col("event_id").alias("seq"), kind.alias("type"), F.when(F.col("user_id") % 20 < 10, "home").otherwise("away").alias("team"))
    windows.run_to_table(windows.live_possession(rows), path, "append")
    return windows.result_of(spark, path)
