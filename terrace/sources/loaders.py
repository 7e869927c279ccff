"""From the sources' files to the columns that the operators take."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import tracking as t
from . import readers, schemas
from .scratch import written


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings from one JSON document, such as {"competitions": [{"competition_id": 1, "season_id": 2}], "pitch": {"length": 105, "width": 68}}."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def configured_seasons(spark: SparkSession, settings: dict) -> DataFrame:
    """(competition_id, season_id) of the settings' competitions."""
    pairs = [(c["competition_id"], c["season_id"]) for c in settings["competitions"]]
    return spark.createDataFrame(pairs, "competition_id long, season_id long")


def configured_matches(matches: DataFrame, seasons: DataFrame) -> DataFrame:
    return matches.join(F.broadcast(seasons), ["competition_id", "season_id"], "left_semi")  # a row for each season in the settings


def read_competitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMPETITION).json(path, multiLine=True)


def read_season(spark: SparkSession, path: str, competition_id: int, season_id: int) -> DataFrame:
    """One season of a table that ``write_by_match`` has written by competition and season: only its folder is read."""
    return readers.season(spark.read.parquet(path), competition_id, season_id)


def operator_events(events: DataFrame) -> DataFrame:
    """Events as the operators take them: places out of their arrays, the order as idx, key passes by the pass's idx, frames as plain points."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    point = F.transform("shot_freeze_frame", lambda p: F.struct(F.get(p["location"], F.lit(0)).alias("px"), F.get(p["location"], F.lit(1)).alias("py"), p["teammate"].alias("teammate"), F.coalesce(p["position"]["name"] == "Goalkeeper", F.lit(False)).alias("is_gk")))
    placed = readers.ensure_columns(events).withColumns({"idx": F.col("index"), "x": at("location", 0), "y": at("location", 1), "end_x": at("pass_end_location", 0), "end_y": at("pass_end_location", 1), "frame": point})
    placed = placed.withColumnsRenamed({"shot_first_time": "first_time", "shot_statsbomb_xg": "sb_xg"})
    passes = placed.where("type = 'Pass'").select(F.col("match_id").alias("of_match"), F.col("id").alias("pass_id"), F.col("idx").alias("key_pass_id"))
    joined = placed.join(passes, (F.col("match_id") == F.col("of_match")) & (F.col("shot_key_pass_id") == F.col("pass_id")), "left")
    return joined.drop("of_match", "pass_id", "index", "location", "pass_end_location", "shot_freeze_frame")


@dataclass
class Game:
    """Tracked games in metres, the home side attacking to the right; tracking has a row for each frame of a player, null where the track is lost."""

    fps: float
    tracking: DataFrame
    ball: DataFrame
    events: DataFrame
    turned: DataFrame
    quality: DataFrame


def same_tracks(a: DataFrame, b: DataFrame, near: float = 1e-8) -> DataFrame:
    """(game, same): whether the games' two tracks (game, frame, x, y) have the same frames and places; missing equals missing."""
    ours = a.select("game", "frame", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(True).alias("in_a"))
    both = ours.join(b.select("game", "frame", F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(True).alias("in_b")), ["game", "frame"], "full")
    apart = lambda p, q: F.col(p).isNull() != F.col(q).isNull()
    far = lambda p, q: F.coalesce(F.abs(F.col(p) - F.col(q)) > near, F.lit(False))
    differs = apart("in_a", "in_b") | apart("ax", "bx") | apart("ay", "by") | far("ax", "bx") | far("ay", "by")
    return both.groupBy("game").agg((F.count_if(differs) == 0).alias("same"))


def load_game(spark: SparkSession, home: str, away: str, feed: str, game: int = 1, clean: bool = True, length: float = g.LENGTH, width: float = g.WIDTH) -> Game:
    """Read both tracking files and the event feed of a game, check that they belong together, and bring all into metres and one direction.

    quality has a row for each side, of the data as they came, and steps_over_max_after, of the cleaned data. Files of
    different frames are an error.
    """
    sides = [readers.read_tracking(spark, path, keep_missing=True).withColumns({"game": F.lit(game), "team": F.lit(team)}) for team, path in (("home", home), ("away", away))]
    return _assembled(sides[0].unionByName(sides[1]), readers.read_feed(spark, feed).withColumn("game", F.lit(game)), clean, length, width)


def load_games(spark: SparkSession, path: str, clean: bool = True, length: float = g.LENGTH, width: float = g.WIDTH) -> Game:
    """``load_game`` for all games of a folder at once: tracking/game=g/team=home or away, and feed/game=g.

    The files are read in one pass and all checks are grouped by game, so that the number of jobs doesn't grow with the games. Games of different frame rates are an error.
    """
    return _assembled(readers.read_trackings(spark, f"{path}/tracking"), readers.read_feed(spark, f"{path}/feed"), clean, length, width)


def _assembled(tracking: DataFrame, feed: DataFrame, clean: bool, length: float, width: float) -> Game:
    x, y = g.tracking_to_metres(F.col("x"), F.col("y"), length, width)
    rows = written(tracking.select("game", "period", "frame", "time_s", "team", "player", x.alias("x"), y.alias("y")), "tracking-rows")
    frames = rows.groupBy("game", "period", "frame", "time_s").agg(F.count_distinct("team").alias("sides"))
    wrong = [r["game"] for r in frames.where("sides <> 2").select("game").distinct().orderBy("game").limit(5).collect()]
    if wrong:
        raise ValueError(f"the sides' files have different frames: games {wrong} and perhaps others")
    rates = [r["fps"] for r in t.frame_rates(rows.where("team = 'home'")).select("fps").distinct().limit(2).collect()]
    if len(rates) != 1:
        raise ValueError("the games have no frame rate in common")
    fps = rates[0]
    balls = {team: rows.where((F.col("team") == team) & (F.col("player") == "Ball")).drop("team", "player") for team in ("home", "away")}
    same = same_tracks(balls["home"], balls["away"]).withColumnRenamed("same", "same_ball")
    players = rows.where("player <> 'Ball'")
    quality = t.quality(players, fps, length, width)
    turned = t.directions(players, length).where("direction = -1").select("game", "period")
    played = t.home_attacks_right(players, length, width)
    flips = turned.withColumn("turned_period", F.col("period"))
    ball = _turned(balls["home"].join(flips, ["game", "period"], "left"), (("x", "y"),), length, width)
    for a, b in (("start_x", "start_y"), ("end_x", "end_y")):
        x, y = g.tracking_to_metres(F.col(a), F.col(b), length, width)
        feed = feed.withColumns({a: x, b: y})
    events = _turned(feed.join(flips, ["game", "period"], "left"), (("start_x", "start_y"), ("end_x", "end_y")), length, width)
    if clean:
        played = t.despike(played, fps)
    fast = t.step_speed(played, True, fps).groupBy("game", "team").agg(F.count_if(F.col("step") > t.MAX_SPEED).alias("steps_over_max_after"))
    return Game(fps, played, ball, events, turned, quality.join(fast, ["game", "team"]).join(same, "game", "left"))


def _turned(rows: DataFrame, points: tuple[tuple[str, str], ...], length: float, width: float) -> DataFrame:
    for a, b in points:
        x, y = g.turned(F.col(a), F.col(b), F.col("turned_period").isNotNull(), length, width)
        rows = rows.withColumns({a: x, b: y})
    return rows.drop("turned_period")
