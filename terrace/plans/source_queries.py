"""Queries that write the sources' file formats and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shots as s
from ..sources import loaders, readers
from ..sources.projections import TRK, ev, table, trk
from ..sources.scratch import shared_path
from .catalogue import Catalogue, rounded
from .match_queries import cat as matches
from .tracking_queries import DIRECTION

cat = Catalogue()


@cat.add(matches.sql["shot_features"])
def shot_features_from_files(spark, sf_dir):
    """Events written as the provider has them, a JSON array for each match, then read with the explicit schema and made into shot features."""
    path = shared_path(spark, "event-files")
    c = F.col
    event = F.struct(
        c("idx").alias("index"), c("idx").cast("string").alias("id"), c("key_pass_id").cast("string").alias("shot_key_pass_id"), "type", "team", "player", "play_pattern", "period", "minute", "competition_id", "season_id",
        F.array("x", "y").alias("location"), F.when(c("end_x").isNotNull(), F.array("end_x", "end_y")).alias("pass_end_location"), "under_pressure", c("first_time").alias("shot_first_time"), "pass_through_ball", "pass_cross",
        "pass_outcome", "pass_type", "shot_outcome", "shot_type", "shot_body_part", c("sb_xg").alias("shot_statsbomb_xg"),
    )
    files = ev(spark, sf_dir).groupBy("match_id").agg(F.to_json(F.collect_list(event)).alias("value"))  # a match a file, as the format has it
    files.write.partitionBy("match_id").text(path)
    events = loaders.operator_events(readers.read_events(spark, path))
    return rounded(s.dataset(events).drop(*s.FREEZE_FEATURES)).withColumns({n: F.col(n).cast("int") for n in ("match_id", "period", "minute", "competition_id", "season_id")})


@cat.add("SELECT year(o_orderdate) AS season, count(*) AS written, count(*) AS keyed, count(*) AS csv, count(*) AS json, count(*) AS alone FROM orders GROUP BY season")
def source_roundtrip(spark, sf_dir):
    """Seasons written by key and as CSV and JSON, read again, and counted against what was written; one read of a single season sees its folder only."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("competition_id"), F.year("o_orderdate").alias("season_id"), F.col("o_totalprice").cast("double").alias("price"))
    path = shared_path(spark, "roundtrip")
    readers.write_by_match(orders, f"{path}/keyed", ("competition_id", "season_id"))
    counts = orders.groupBy(F.col("season_id").alias("season")).agg(F.count(F.lit(1)).alias("written"))
    readers.write_table(counts, f"{path}/csv")
    readers.write_document(counts, f"{path}/json")
    keyed = spark.read.parquet(f"{path}/keyed").groupBy(F.col("season_id").alias("season")).agg(F.count(F.lit(1)).alias("keyed"))
    csv = readers.read_table(spark, f"{path}/csv").select(F.col("season").cast("int").alias("season"), F.col("written").cast("long").alias("csv"))
    json = readers.read_document(spark, f"{path}/json").select(F.col("season").cast("int").alias("season"), F.col("written").cast("long").alias("json"))
    seasons = [r["season"] for r in counts.select("season").collect()]  # a row for each year
    alone = spark.createDataFrame([(year, loaders.read_season(spark, f"{path}/keyed", 1, year).count()) for year in seasons], "season int, alone long")
    return counts.join(keyed, "season").join(csv, "season").join(json, "season").join(alone, "season")


SQUAD = [f"Player{i}" for i in range(1, 12)]


def _game_folder(spark, sf_dir) -> str:
    """Tracking and feed files of all games as the provider has them: wide lines under three header lines a side, places as shares of the pitch, NaN where lost."""
    path = shared_path(spark, "games")
    rows = trk(spark, sf_dir)
    place = F.concat_ws(",", F.col("x") / 105, 1 - F.col("y") / 68)
    cells = F.map_from_entries(F.collect_list(F.when(F.col("x").isNotNull(), F.struct(F.concat("team", "player"), place))))
    frames = rows.groupBy("game", "period", "frame", "time_s").agg(cells.alias("at")).withColumn("team", F.explode(F.array(F.lit("home"), F.lit("away"))))
    line = F.concat_ws(",", "period", "frame", "time_s", *[F.coalesce(F.col("at")[F.concat(F.col("team"), F.lit(p))], F.lit("NaN,NaN")) for p in SQUAD], F.col("frame") % 101 / 100, F.lit("0.5"))
    heads = [",".join([",,"] + [f"{side}," for _ in range(12)]) for side in ("Side", "1")] + ["Period,Frame,Time [s]," + ",".join(f"{p}," for p in [*SQUAD, "Ball"])]
    head = frames.select("game", "team").distinct().select("game", "team", F.explode(F.array(*[F.lit(h) for h in heads])).alias("value"))
    # A side's lines, bounded by a game, come to one task first: else each task would write a file for each side of each game.
    frames.select("game", "team", line.alias("value")).unionByName(head).repartition("game", "team").write.partitionBy("game", "team").text(f"{path}/tracking")
    c = F.col
    feed = rows.select(
        "game", F.initcap("team").alias("Team"), F.lit("CARRY").alias("Type"), F.lit(None).cast("string").alias("Subtype"), c("period").alias("Period"), c("frame").alias("Start Frame"), c("time_s").alias("Start Time [s]"), (c("frame") + 1).alias("End Frame"),
        (c("time_s") + 0.04).alias("End Time [s]"), c("player").alias("From"), F.lit(None).cast("string").alias("To"), (c("x") / 105).alias("Start X"), (1 - c("y") / 68).alias("Start Y"), F.lit(None).cast("double").alias("End X"), F.lit(None).cast("double").alias("End Y"),
    )
    feed.repartition("game").write.partitionBy("game").csv(f"{path}/feed", header=True, nullValue="NaN")
    return path


GAMES = f"WITH trk AS ({TRK}), {DIRECTION}"


@cat.add(f"""{GAMES}, fr AS (SELECT DISTINCT game, period, frame, time_s FROM trk), sq AS (SELECT t.team, concat('Player', CAST(p.p AS VARCHAR)) AS player FROM (VALUES ('home'),('away')) t(team), range(1,12) p(p))
SELECT fr.game, CAST(fr.period AS BIGINT) AS period, CAST(fr.frame AS BIGINT) AS frame, round(fr.time_s,4) AS time_s, sq.team, sq.player, round(CASE WHEN direction=-1 THEN 105-x ELSE x END,4) AS x, round(CASE WHEN direction=-1 THEN 68-y ELSE y END,4) AS y
FROM fr CROSS JOIN sq LEFT JOIN trk ON trk.game=fr.game AND trk.frame=fr.frame AND trk.team=sq.team AND trk.player=sq.player LEFT JOIN dr ON dr.game=fr.game AND dr.period=fr.period""")
def load_games_tracking(spark, sf_dir):
    """All games written as files, read in one pass, checked and turned: a row for each frame of a player."""
    games = loaders.load_games(spark, _game_folder(spark, sf_dir), clean=False)
    return rounded(games.tracking.select("game", "period", "frame", "time_s", "team", "player", "x", "y"))


@cat.add(f"""{GAMES} SELECT trk.game, CAST(trk.period AS BIGINT) AS period, CAST(frame AS BIGINT) AS start_frame, team, player AS player_from, round(CASE WHEN direction=-1 THEN 105-x ELSE x END,4) AS start_x, round(CASE WHEN direction=-1 THEN 68-y ELSE y END,4) AS start_y, CAST(NULL AS DOUBLE) AS end_x
FROM trk LEFT JOIN dr ON dr.game=trk.game AND dr.period=trk.period""")
def load_games_events(spark, sf_dir):
    """The feeds of all games, turned as their tracking is."""
    games = loaders.load_games(spark, _game_folder(spark, sf_dir), clean=False)
    return rounded(games.events.select("game", "period", "start_frame", "team", "player_from", "start_x", "start_y", "end_x"))
