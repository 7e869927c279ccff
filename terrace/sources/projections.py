"""Deterministic projections of the driver's ``events`` table, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EV = """
WITH b AS (
 SELECT event_id, user_id, event_type, value, ts, CAST(dayofmonth(ts) AS INT) AS match_id,
        CAST(hour(ts)*60+minute(ts) AS INT) AS m, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k
 FROM events),
c AS (
 SELECT b.*, CASE WHEN m<420 THEN 1 WHEN m<840 THEN 2 WHEN m<1080 THEN 3 WHEN m<1320 THEN 4 ELSE 5 END AS period,
   concat('P', CAST(user_id % 22 AS STRING)) AS player,
   CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team,
   CASE event_type WHEN 'purchase' THEN 'Shot' WHEN 'click' THEN 'Pass' WHEN 'view' THEN 'Ball Receipt*' WHEN 'signup' THEN 'Carry'
     ELSE CASE k % 10 WHEN 0 THEN 'Own Goal For' WHEN 1 THEN 'Substitution' ELSE 'Pressure' END END AS type,
   60 + k*0.6e0 AS x, (event_id*17 % 801)/1.0e1 AS y
 FROM b),
d AS (
 SELECT event_id AS idx, match_id, period,
  CAST(CASE period WHEN 1 THEN floor(m/8.0e0) WHEN 2 THEN 45+floor((m-420)/8.0e0) WHEN 3 THEN 90+floor((m-840)/1.4e1)
       WHEN 4 THEN 105+floor((m-1080)/1.4e1) ELSE 120 END AS INT) AS minute,
  team, player, type, x, y,
  CASE WHEN type='Shot' THEN CASE WHEN value>100 THEN 'Goal' ELSE 'Saved' END END AS shot_outcome,
  CASE WHEN type='Shot' THEN CASE event_id%20 WHEN 0 THEN 'Penalty' WHEN 1 THEN 'Free Kick' WHEN 2 THEN 'Corner' ELSE 'Open Play' END END AS shot_type,
  CASE WHEN type='Pass' AND event_id%5=0 THEN 'Incomplete' END AS pass_outcome,
  CASE WHEN type='Pass' THEN lead(player) OVER (PARTITION BY match_id, team ORDER BY event_id) END AS pass_recipient,
  lag(event_id) OVER (PARTITION BY match_id, team ORDER BY event_id) AS prev_id,
  lead(x) OVER (PARTITION BY match_id, team ORDER BY event_id) AS next_x,
  lead(y) OVER (PARTITION BY match_id, team ORDER BY event_id) AS next_y
 FROM c)
SELECT idx, match_id, period, minute, team, player, type, x, y, shot_outcome, shot_type, pass_outcome, pass_recipient, prev_id,
 CASE WHEN type='Shot' THEN prev_id END AS key_pass_id,
 CASE WHEN type='Pass' THEN next_x END AS end_x, CASE WHEN type='Pass' THEN next_y END AS end_y,
 CASE WHEN type='Pass' AND idx%7=0 THEN 'Goal Kick' WHEN type='Pass' AND idx%7=1 THEN 'Corner' END AS pass_type,
 CASE WHEN type='Pass' AND idx%11=0 THEN TRUE END AS pass_shot_assist, CASE WHEN type='Pass' AND idx%13=0 THEN TRUE END AS pass_goal_assist,
 CASE WHEN type='Pass' AND idx%3=0 THEN TRUE END AS pass_through_ball, CASE WHEN type='Pass' AND idx%4=0 THEN TRUE END AS pass_cross,
 CASE WHEN idx%6=0 THEN TRUE END AS under_pressure, CASE WHEN type='Shot' AND idx%9=0 THEN TRUE END AS first_time,
 CASE WHEN type='Shot' THEN CASE idx%4 WHEN 0 THEN 'Head' WHEN 1 THEN 'Left Foot' WHEN 2 THEN 'Right Foot' ELSE 'Chest' END END AS shot_body_part,
 CASE WHEN type='Ball Receipt*' AND idx%8=0 THEN 'Incomplete' END AS ball_receipt_outcome,
 CASE idx%7 WHEN 0 THEN 'From Corner' WHEN 1 THEN 'From Free Kick' WHEN 2 THEN 'From Throw In' ELSE 'Regular Play' END AS play_pattern,
 CAST(match_id%3 AS INT) AS competition_id, CAST(match_id%2 AS INT) AS season_id,
 CASE WHEN type='Shot' THEN CASE WHEN shot_outcome='Goal' THEN 0.3e0 ELSE 0.05e0 END + (idx%10)*1.0e-2 END AS sb_xg
FROM d"""

TRK = """
WITH a AS (
 SELECT CAST(user_id % 22 AS INT) AS p, event_id, value, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k, CAST(floor(event_id/5.0e3) AS INT)+1 AS game FROM events),
f AS (
 SELECT a.*, CAST(row_number() OVER (PARTITION BY game, p ORDER BY event_id) AS INT) AS frame, CAST(floor(p/2.0e0) AS INT) AS r FROM a),
g AS (
 SELECT f.*, abs((frame*(1 + r%4) + r*17) % 400 - 200)*1.0e-1 AS tri FROM f)
SELECT game, CASE WHEN frame <= 100 THEN 1 ELSE 2 END AS period, frame, frame/2.5e1 AS time_s,
 CASE WHEN p % 2 = 0 THEN 'home' ELSE 'away' END AS team, concat('Player', CAST(r+1 AS STRING)) AS player,
 CASE WHEN value < 1 THEN NULL ELSE (CASE WHEN p%2=0 THEN 5 + r*7 + tri ELSE 100 - r*7 - tri END) + k*1.0e-3 + CASE WHEN value > 200 THEN 15 ELSE 0 END END AS x,
 CASE WHEN value < 1 THEN NULL ELSE 4 + (r*13 % 60) + k*1.0e-3 END AS y
FROM g"""


def _of_events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match events."""
    return _of_events(spark, sf_dir, EV)


def trk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tracking rows; x and y are null where the track is lost."""
    return _of_events(spark, sf_dir, TRK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
