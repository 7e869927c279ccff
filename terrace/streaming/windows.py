"""Event-time windows and live possession over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, width: str = "1 day", late: str = "2 days", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Events by window and key; a stream forgets windows that are ``late`` behind the latest event."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, n): runs of a key's events with no longer gap."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, gap) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def live_possession(feed: DataFrame) -> DataFrame:
    """(game, seq, holder) for a stream of feed events: the state is the holder so far, kept for each game.

    Events of a game must arrive in order of seq from one batch to the next; within a batch they are sorted.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        holder = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for kind, team in zip(rows["type"], rows["team"]):
            holder = "" if kind == "BALL OUT" else team if kind in ("PASS", "SHOT", "RECOVERY", "SET PIECE") else holder
            out.append(holder)
        state.update((holder,))
        yield pd.DataFrame({"game": key[0], "seq": rows["seq"].to_numpy(), "holder": out})

    return feed.select("game", "seq", "type", "team").groupBy("game").applyInPandasWithState(run, "game int, seq long, holder string", "holder string", "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, mode: str = "complete") -> None:
    """Run a stream over what its source holds now, from where an earlier run at ``path`` ended, and leave its result as a table there.

    A batch that runs again after a failure replaces what it had written.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/of={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()


def result_of(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``run_to_table`` has left."""
    return spark.read.parquet(f"{path}/table").drop("of")
