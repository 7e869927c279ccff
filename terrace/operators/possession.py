"""Who has the ball: the latest event's team, held until the next event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOLDS = ("PASS", "SHOT", "RECOVERY", "SET PIECE")
OUT = "BALL OUT"


def possession(frames: DataFrame, feed: DataFrame) -> DataFrame:
    """(game, period, frame, holder) with holder home, away or '' (dead ball).

    frames has game, period, frame; feed has game, type, team, start_frame and seq, the order of its rows. The latest of several events on a
    frame counts; a ball out and the start of a period without an event make the ball dead.
    """
    marks = feed.where(F.col("type").isin(*HOLDS, OUT)).withColumn("mark", F.when(F.col("type") == OUT, "").otherwise(F.col("team")))
    latest = marks.groupBy("game", F.col("start_frame").alias("frame")).agg(F.max_by("mark", "seq").alias("mark"))
    spine = frames.select("game", "period", "frame").distinct().join(latest, ["game", "frame"], "left")
    first = F.row_number().over(Window.partitionBy("game", "period").orderBy("frame")) == 1
    reset = spine.withColumn("mark", F.when(first, F.coalesce("mark", F.lit(""))).otherwise(F.col("mark")))
    held = F.last("mark", ignorenulls=True).over(Window.partitionBy("game").orderBy("frame"))
    return reset.select("game", "period", "frame", F.coalesce(held, F.lit("")).alias("holder"))


def shares(held: DataFrame) -> DataFrame:
    share = lambda v: F.avg((F.col("holder") == v).cast("double"))
    return held.groupBy("game").agg(share("home").alias("home"), share("away").alias("away"), share("").alias("dead"))


def state(team: str = "team", holder: str = "holder"):
    return F.when(F.col(holder) == F.col(team), "in possession").when(F.coalesce(F.col(holder), F.lit("")) == "", "unknown/dead ball").otherwise("out of possession")
