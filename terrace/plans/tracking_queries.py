"""Queries over player tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import possession as poss
from ..operators import shape as sh
from ..operators import tracking as t
from ..sources.projections import EV, TRK, ev, trk
from .catalogue import Catalogue, rounded

cat = Catalogue()
W = f"WITH trk AS ({TRK})"
PER = "(PARTITION BY game, team, player, period ORDER BY frame)"
ALL = "(PARTITION BY game, team, player ORDER BY frame)"
FEED = f"""feed AS (SELECT CAST(floor(idx/5.0e3) AS INT)+1 AS game, CASE type WHEN 'Pass' THEN 'PASS' WHEN 'Shot' THEN 'SHOT' WHEN 'Substitution' THEN 'BALL OUT' WHEN 'Carry' THEN 'CHALLENGE' ELSE 'RECOVERY' END AS type,
  CASE WHEN team='A' THEN 'home' ELSE 'away' END AS team, CAST(row_number() OVER (PARTITION BY floor(idx/5.0e3) ORDER BY idx) AS INT) AS start_frame, idx AS seq FROM ({EV}) e)"""
HELD = f"""{FEED}, sp AS (SELECT DISTINCT game, period, frame FROM trk), mk AS (SELECT game, start_frame AS frame, arg_max(CASE WHEN type='BALL OUT' THEN '' ELSE team END, seq) AS mark FROM feed WHERE type IN ('PASS','SHOT','RECOVERY','SET PIECE','BALL OUT') GROUP BY game, start_frame),
m1 AS (SELECT sp.game, period, sp.frame, CASE WHEN row_number() OVER (PARTITION BY sp.game, period ORDER BY sp.frame)=1 THEN coalesce(mark,'') ELSE mark END AS mark FROM sp LEFT JOIN mk ON sp.game=mk.game AND sp.frame=mk.frame),
held AS (SELECT game, period, frame, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY game ORDER BY frame ROWS UNBOUNDED PRECEDING),'') AS holder FROM m1)"""
GK = """gm AS (SELECT game, team, player, avg(x) AS mx FROM trk GROUP BY ALL),
gk AS (SELECT DISTINCT ON (game, team) game, team, player FROM gm WHERE mx IS NOT NULL ORDER BY game, team, CASE WHEN team='home' THEN mx ELSE -mx END, player)"""


def feed(spark, sf_dir) -> DataFrame:
    """The events as the games' tracking feed: a game's rows' order gives the frames."""
    from pyspark.sql import Window

    kind = F.when(F.col("type") == "Pass", "PASS").when(F.col("type") == "Shot", "SHOT").when(F.col("type") == "Substitution", "BALL OUT").when(F.col("type") == "Carry", "CHALLENGE").otherwise("RECOVERY")
    game = (F.floor(F.col("idx") / 5000) + 1).cast("int")
    at = F.row_number().over(Window.partitionBy(game).orderBy("idx"))
    return ev(spark, sf_dir).select(game.alias("game"), kind.alias("type"), F.when(F.col("team") == "A", "home").otherwise("away").alias("team"), at.alias("start_frame"), F.col("idx").alias("seq"))


def held(spark, sf_dir) -> DataFrame:
    return poss.possession(trk(spark, sf_dir), feed(spark, sf_dir))


def _speed_sql(src: str) -> str:
    terms = lambda c: " + ".join(f"({i})*{'lead' if i > 0 else 'lag'}({c},{abs(i)}) OVER {PER}" for i in range(-6, 7) if i)
    second = lambda c: " + ".join(f"({i * i - 14})*{'lead' if i > 0 else 'lag'}({c},{abs(i)}) OVER {PER}" for i in range(-6, 7))
    known = "count(x) OVER (PARTITION BY game, team, player, period ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)=13"
    return f"""sg AS (SELECT *, CASE WHEN {known} THEN sqrt(power(({terms('x')})*25e0/182,2)+power(({terms('y')})*25e0/182,2)) END AS speed,
 CASE WHEN {known} THEN sqrt(power(({second('x')})*2*625e0/2002,2)+power(({second('y')})*2*625e0/2002,2)) END AS accel FROM {src})"""


@cat.add(f"{W} SELECT game, period, frame, time_s, team, player, x, y FROM trk WHERE x IS NOT NULL AND y IS NOT NULL")
def tracking_long(spark, sf_dir):
    return trk(spark, sf_dir).where("x IS NOT NULL AND y IS NOT NULL").select("game", "period", "frame", "time_s", "team", "player", "x", "y")


@cat.add(f"{W} SELECT frame, team, player, round(x/120*105,6) AS x, round((1-y/80)*68,6) AS y FROM trk")
def to_metres(spark, sf_dir):
    from ..functions.geometry import tracking_to_metres

    x, y = tracking_to_metres(F.col("x") / 120, F.col("y") / 80)
    return rounded(trk(spark, sf_dir).select("frame", "team", "player", x.alias("x"), y.alias("y")), 6)


DIRECTION = "dr AS (SELECT game, period, CASE WHEN avg(x)<52.5 THEN 1 ELSE -1 END AS direction FROM trk JOIN (SELECT game, period, min(frame) AS frame FROM trk GROUP BY game, period) f USING (game, period, frame) WHERE team='home' GROUP BY game, period)"


@cat.add(f"{W}, {DIRECTION} SELECT game, period, direction FROM dr")
def attack_direction(spark, sf_dir):
    return t.directions(trk(spark, sf_dir))


@cat.add(f"{W}, {DIRECTION} SELECT frame, team, player, round(CASE WHEN direction=-1 THEN 105-x ELSE x END,4) AS x, round(CASE WHEN direction=-1 THEN 68-y ELSE y END,4) AS y FROM trk LEFT JOIN dr USING (game, period)")
def flip_periods(spark, sf_dir):
    return rounded(t.home_attacks_right(trk(spark, sf_dir)).select("frame", "team", "player", "x", "y"))


@cat.add(f"{W} SELECT frame, team, player, round(CASE WHEN team='away' THEN 105-x ELSE x END,4) AS x, round(CASE WHEN team='away' THEN 68-y ELSE y END,4) AS y FROM trk")
def attack_relative(spark, sf_dir):
    return rounded(t.attack_relative(trk(spark, sf_dir)).select("frame", "team", "player", "x", "y"))


@cat.add(f"""{W}, s AS (SELECT *, sqrt(power(x-lag(x) OVER {ALL},2)+power(y-lag(y) OVER {ALL},2))*25 AS step, coalesce(abs(x-lag(x) OVER {ALL})+abs(y-lag(y) OVER {ALL}),0) AS moved FROM trk),
f AS (SELECT game, team, frame, count(x) AS n, sum(moved) AS moved FROM s GROUP BY ALL),
a AS (SELECT game, team, count(DISTINCT player) AS squad, round(avg(CASE WHEN x IS NULL THEN 1e0 ELSE 0e0 END),4) AS missing_share, round(avg(CASE WHEN x<0 OR x>105 OR y<0 OR y>68 THEN 1e0 WHEN x IS NOT NULL THEN 0e0 END),4) AS outside_share, count(*) FILTER (step>12) AS steps_over_max, round(max(step),2) AS max_step FROM s GROUP BY ALL)
SELECT a.*, b.max_players, b.frames_under_11, b.frozen_frames FROM a JOIN (SELECT game, team, max(n) AS max_players, count(*) FILTER (n<11) AS frames_under_11, count(*) FILTER (moved=0) AS frozen_frames FROM f GROUP BY ALL) b USING (game, team)""")
def tracking_quality(spark, sf_dir):
    return rounded(t.quality(trk(spark, sf_dir))).withColumn("max_step", F.round("max_step", 2))


@cat.add(f"{W}, f AS (SELECT DISTINCT game, frame FROM trk), l AS (SELECT game, frame-lag(frame) OVER (PARTITION BY game ORDER BY frame) AS gap FROM f) SELECT game, count(*) AS frames, count(*) FILTER (gap<>1) AS frame_gaps FROM l GROUP BY game")
def frame_gaps(spark, sf_dir):
    return t.frame_gaps(trk(spark, sf_dir))


@cat.add(f"{W} SELECT frame, team, player, round(sqrt(power(x-lag(x) OVER {PER},2)+power(y-lag(y) OVER {PER},2))*25,4) AS step FROM trk")
def step_speed(spark, sf_dir):
    return rounded(t.step_speed(trk(spark, sf_dir), True).select("frame", "team", "player", "step"))


MED = "PARTITION BY game, team, player, period ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING"
MEDIAN = f"md AS (SELECT *, CASE WHEN count(x) OVER ({MED})>=5 THEN quantile_cont(x,0.5) OVER ({MED}) END AS mx, CASE WHEN count(y) OVER ({MED})>=5 THEN quantile_cont(y,0.5) OVER ({MED}) END AS my FROM trk)"


@cat.add(f"{W}, {MEDIAN} SELECT frame, team, player, round(mx,4) AS mx, round(my,4) AS my FROM md")
def rolling_median(spark, sf_dir):
    return rounded(t.rolling_median(trk(spark, sf_dir)).select("frame", "team", "player", "mx", "my"))


def _repair_sql(name: str, src: str, bad: str) -> str:
    whole = "(PARTITION BY game, team, player, period, run ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    line = lambda c: f"CASE WHEN ok THEN a{c}+(z{c}-a{c})*i/(n+1) ELSE {c} END"
    return f"""{name}0 AS (SELECT * EXCLUDE (bad), coalesce(bad,FALSE) AS bad FROM (SELECT *, {bad} AS bad FROM {src})),
{name}1 AS (SELECT *, sum(CASE WHEN bad<>coalesce(lb,FALSE) THEN 1 ELSE 0 END) OVER {PER} AS run FROM (SELECT *, lag(bad) OVER {PER} AS lb FROM {name}0)),
{name}2 AS (SELECT * REPLACE (CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y) FROM {name}1),
{name}3 AS (SELECT *, lag(x) OVER {PER} AS px, lag(y) OVER {PER} AS py, lead(x) OVER {PER} AS nx, lead(y) OVER {PER} AS ny FROM {name}2),
{name}4 AS (SELECT *, first_value(px) OVER {whole} AS ax, first_value(py) OVER {whole} AS ay, last_value(nx) OVER {whole} AS zx, last_value(ny) OVER {whole} AS zy, count(*) OVER {whole} AS n,
  row_number() OVER (PARTITION BY game, team, player, period, run ORDER BY frame) AS i FROM {name}3),
{name}5 AS (SELECT *, bad AND coalesce(n<=25 AND sqrt(power(zx-ax,2)+power(zy-ay,2))<=12e0*(n+1)/25, FALSE) AS ok FROM {name}4),
{name} AS (SELECT game, period, frame, team, player, {line('x')} AS x, {line('y')} AS y, flagged+CASE WHEN bad THEN {1 if name == 'ra' else 0} ELSE 0 END AS flagged, blanked+CASE WHEN bad THEN {0 if name == 'ra' else 1} ELSE 0 END AS blanked,
  lost+CASE WHEN bad AND NOT ok THEN 1 ELSE 0 END AS lost FROM {name}5)"""


_FAST = f"coalesce(sqrt(power(lead(x) OVER {PER}-x,2)+power(lead(y) OVER {PER}-y,2))*25>12,FALSE) OR coalesce(sqrt(power(x-lag(x) OVER {PER},2)+power(y-lag(y) OVER {PER},2))*25>12,FALSE)"
CLEAN = f"{MEDIAN}, m0 AS (SELECT *, 0 AS flagged, 0 AS blanked, 0 AS lost FROM md), {_repair_sql('ra', 'm0', 'sqrt(power(x-mx,2)+power(y-my,2))>2')}, {_repair_sql('rb', 'ra', _FAST)}, {_repair_sql('rc', 'rb', _FAST)}"


@cat.add(f"{W}, {CLEAN} SELECT frame, team, player, round(x,4) AS x, round(y,4) AS y, CAST(flagged AS INT) AS flagged, CAST(blanked AS INT) AS blanked, CAST(lost AS INT) AS lost FROM rc")
def despike(spark, sf_dir):
    return rounded(t.despike(trk(spark, sf_dir)).select("frame", "team", "player", "x", "y", "flagged", "blanked", "lost"))


@cat.add(f"{W}, {CLEAN} SELECT team, CAST(sum(flagged) AS BIGINT) AS flagged, CAST(sum(blanked) AS BIGINT) AS blanked, CAST(sum(lost) AS BIGINT) AS lost, count(x) AS known FROM rc GROUP BY team")
def repair_gaps(spark, sf_dir):
    return t.despike(trk(spark, sf_dir)).groupBy("team").agg(F.sum("flagged").alias("flagged"), F.sum("blanked").alias("blanked"), F.sum("lost").alias("lost"), F.count("x").alias("known"))


RAW = f"rk AS (SELECT *, abs(speed-lag(speed) OVER {ALL})*25 AS accel FROM (SELECT *, sqrt(power(x-lag(x) OVER {PER},2)+power(y-lag(y) OVER {PER},2))*25 AS speed FROM trk))"


@cat.add(f"{W}, {RAW} SELECT frame, team, player, round(speed,3) AS speed, round(accel,3) AS accel FROM rk")
def raw_kinematics(spark, sf_dir):
    return rounded(t.raw_kinematics(trk(spark, sf_dir)).select("frame", "team", "player", "speed", "accel"), 3)


@cat.add(f"{W}, {_speed_sql('trk')} SELECT frame, team, player, round(speed,3) AS speed, round(accel,3) AS accel FROM sg")
def savgol_speed(spark, sf_dir):
    return rounded(t.smooth_kinematics(trk(spark, sf_dir)).select("frame", "team", "player", "speed", "accel"), 3)


def _noise_sql(src: str, kind: str) -> str:
    return f"SELECT game, '{kind}' AS kind, {', '.join(f'round(quantile_cont({c},0.99),3) AS {c}_p99, round(max({c}),3) AS {c}_max, round(avg(CASE WHEN {c}>{m} THEN 1e0 WHEN {c} IS NOT NULL THEN 0e0 END),4) AS {c}_over' for c, m in (('speed', 12), ('accel', 10)))} FROM {src} GROUP BY game"


@cat.add(f"{W}, {RAW}, {_speed_sql('trk')} {_noise_sql('rk', 'raw')} UNION ALL {_noise_sql('sg', 'smooth')}")
def noise_comparison(spark, sf_dir):
    rows = trk(spark, sf_dir)
    both = t.noise(t.raw_kinematics(rows)).withColumn("kind", F.lit("raw")).unionByName(t.noise(t.smooth_kinematics(rows)).withColumn("kind", F.lit("smooth")))
    return both.select("game", "kind", *[F.round(f"{c}_{s}", p).alias(f"{c}_{s}") for c in ("speed", "accel") for s, p in (("p99", 3), ("max", 3), ("over", 4))])


SPRINTS = f"""sr AS (SELECT *, sum(CASE WHEN h AND NOT coalesce(lh,FALSE) THEN 1 ELSE 0 END) OVER {ALL} AS island FROM (SELECT *, lag(h) OVER {ALL} AS lh FROM (SELECT *, coalesce(speed>=7,FALSE) AS h FROM sg))),
sp1 AS (SELECT game, team, player, island, count(*) AS n FROM sr WHERE h GROUP BY ALL), sprints AS (SELECT game, team, player, count(*) AS sprints FROM sp1 WHERE n>=25 GROUP BY ALL)"""


@cat.add(f"{W}, {_speed_sql('trk')}, {SPRINTS} SELECT team, player, sprints FROM sprints")
def sprints(spark, sf_dir):
    return t.sprints(t.smooth_kinematics(trk(spark, sf_dir))).select("team", "player", "sprints")


ZONE = "CASE WHEN speed*3.6<7.2 THEN 'walking' WHEN speed*3.6<14.4 THEN 'jogging' WHEN speed*3.6<19.8 THEN 'running' WHEN speed*3.6<25.2 THEN 'high_speed' ELSE 'sprinting' END"


@cat.add(f"{W}, {_speed_sql('trk')} SELECT team, {ZONE} AS zone, count(*) AS frames, round(sum(speed)/25,2) AS metres FROM sg WHERE speed IS NOT NULL GROUP BY ALL")
def speed_zones(spark, sf_dir):
    rows = t.smooth_kinematics(trk(spark, sf_dir)).where("speed IS NOT NULL").withColumn("zone", t.zone(F.col("speed") * 3.6))
    return rows.groupBy("team", "zone").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("speed") / 25, 2).alias("metres"))


PHYSICAL = f"""{W}, {_speed_sql('trk')}, {SPRINTS}, {GK}, ph AS (SELECT game, team, player, round(count(*)/25e0/60,1) AS minutes, round(sum(speed/25),0) AS distance_m, round(max(speed)*3.6,1) AS top_speed_kmh,
  {', '.join(f"round(coalesce(sum(CASE WHEN {ZONE}='{z}' THEN speed/25 END),0),0) AS dist_{z}_m" for z, _ in t.ZONES)} FROM sg WHERE speed IS NOT NULL GROUP BY ALL),
pt AS (SELECT ph.*, gk.player IS NOT NULL AS is_gk, coalesce(sprints,0) AS sprints FROM ph LEFT JOIN gk USING (game, team, player) LEFT JOIN sprints USING (game, team, player))"""


def _physical(spark, sf_dir) -> DataFrame:
    rows = trk(spark, sf_dir)
    return t.physical_table(t.smooth_kinematics(rows), t.goalkeepers(rows))


@cat.add(f"{PHYSICAL} SELECT * FROM pt")
def physical_table(spark, sf_dir):
    return _physical(spark, sf_dir)


@cat.add(f"{PHYSICAL} SELECT game, count(*) AS players, min(distance_m) AS least, max(distance_m) AS most FROM pt WHERE NOT is_gk AND minutes>0.1 GROUP BY game")
def full_match_range(spark, sf_dir):
    return t.full_match_range(_physical(spark, sf_dir), 0.1)


@cat.add(f"{W}, {GK} SELECT game, team, player FROM gk")
def goalkeepers(spark, sf_dir):
    return t.goalkeepers(trk(spark, sf_dir))


@cat.add(f"{W} SELECT game, team, player, x, y FROM trk WHERE frame=101 AND x IS NOT NULL")
def positions_at(spark, sf_dir):
    return t.positions_at(trk(spark, sf_dir), 101)


@cat.add(f"{W}, {HELD} SELECT game, period, frame, holder FROM held")
def possession(spark, sf_dir):
    return held(spark, sf_dir)


@cat.add(f"{W}, {HELD} SELECT game, round(avg(CASE WHEN holder='home' THEN 1e0 ELSE 0e0 END),4) AS home, round(avg(CASE WHEN holder='away' THEN 1e0 ELSE 0e0 END),4) AS away, round(avg(CASE WHEN holder='' THEN 1e0 ELSE 0e0 END),4) AS dead FROM held GROUP BY game")
def possession_share(spark, sf_dir):
    return rounded(poss.shares(held(spark, sf_dir)))


def _shape_sql(step: int) -> str:
    return f"""{GK}, fr AS (SELECT game, frame FROM (SELECT game, frame, row_number() OVER (PARTITION BY game ORDER BY frame)-1 AS nth FROM (SELECT DISTINCT trk.game, trk.frame FROM trk ANTI JOIN gk USING (game, team, player))) WHERE nth%{step}=0),
s0 AS (SELECT game, team, period, frame, count(x) AS n, avg(x) AS cx, avg(y) AS cy, max(x)-min(x) AS l, max(y)-min(y) AS w FROM trk ANTI JOIN gk USING (game, team, player) JOIN fr USING (game, frame) GROUP BY ALL),
shp AS (SELECT game, team, period, frame, CASE WHEN n>=8 THEN n END AS n_outfield, CASE WHEN n>=8 THEN cx END AS centroid_x, CASE WHEN n>=8 THEN cy END AS centroid_y, CASE WHEN n>=8 THEN l END AS length, CASE WHEN n>=8 THEN w END AS width FROM s0)"""


SHAPE = ["game", "team", "period", "frame", "n_outfield", "centroid_x", "centroid_y", "length", "width"]


@cat.add(f"{W}, {_shape_sql(5)} SELECT game, team, period, frame, n_outfield, round(centroid_x,4) AS centroid_x, round(centroid_y,4) AS centroid_y, round(length,4) AS length, round(width,4) AS width FROM shp")
def team_shape(spark, sf_dir):
    return rounded(sh.team_shape(trk(spark, sf_dir), hull=False).select(*SHAPE))


@cat.add(f"{W}, {_shape_sql(25)} SELECT game, team, period, frame, n_outfield, round(centroid_x,4) AS centroid_x, round(centroid_y,4) AS centroid_y, round(length,4) AS length, round(width,4) AS width FROM shp")
def shape_1hz(spark, sf_dir):
    return rounded(sh.team_shape(trk(spark, sf_dir), 25, hull=False).select(*SHAPE))


#: An edge of the hull has all points on its left; of points in a line the outer two are the edge.
HULL = f"""{W}, {_shape_sql(5)}, hp AS (SELECT DISTINCT t.game, t.team, t.period, t.frame, x, y FROM trk t ANTI JOIN gk USING (game, team, player) JOIN fr ON t.game=fr.game AND t.frame=fr.frame WHERE x IS NOT NULL),
he AS (SELECT a.game, a.team, a.period, a.frame, a.x*b.y-b.x*a.y AS e, (SELECT bool_and((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)>0 OR ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)=0 AND (c.x-a.x)*(c.x-b.x)+(c.y-a.y)*(c.y-b.y)<=0))
  FROM hp c WHERE c.game=a.game AND c.team=a.team AND c.period=a.period AND c.frame=a.frame) AS outer_edge FROM hp a JOIN hp b ON a.game=b.game AND a.team=b.team AND a.period=b.period AND a.frame=b.frame AND (a.x<>b.x OR a.y<>b.y)),
ha AS (SELECT game, team, period, frame, sum(e)/2 AS area FROM he WHERE outer_edge GROUP BY ALL)"""


@cat.add(f"{HULL} SELECT game, team, period, frame, n_outfield, round(CASE WHEN n_outfield IS NOT NULL AND area>0 THEN area END,4) AS hull_area FROM shp LEFT JOIN ha USING (game, team, period, frame)")
def hull_area(spark, sf_dir):
    return rounded(sh.team_shape(trk(spark, sf_dir)).select("game", "team", "period", "frame", "n_outfield", "hull_area"))


@cat.add(f"{W}, {_shape_sql(5)} SELECT team, frame, round(avg(length) OVER (PARTITION BY game, team, period ORDER BY frame ROWS BETWEEN 14 PRECEDING AND CURRENT ROW),4) AS length_rolling FROM shp")
def shape_rolling(spark, sf_dir):
    return rounded(sh.rolling(sh.team_shape(trk(spark, sf_dir), hull=False), "length", 3.0, 5).select("team", "frame", "length_rolling"))


@cat.add(f"{W}, {_shape_sql(5)} SELECT team, period, frame, round(centroid_x,6) AS centroid_x, round(avg(centroid_x) OVER (PARTITION BY game, team, period ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),6) AS centroid_x_rolling FROM shp")
def shape_timeline(spark, sf_dir):
    return rounded(sh.rolling(sh.team_shape(trk(spark, sf_dir), hull=False), "centroid_x", 1.0, 5).select("team", "period", "frame", "centroid_x", "centroid_x_rolling"), 6)


@cat.add(f"""{W}, {HELD}, {_shape_sql(5)}, j AS (SELECT shp.*, CASE WHEN holder=team THEN 'in possession' WHEN coalesce(holder,'')='' THEN 'unknown/dead ball' ELSE 'out of possession' END AS state FROM shp LEFT JOIN held USING (game, frame))
SELECT game, team, state, {', '.join(f'round(avg({c}),7) AS {c}_mean, round(stddev_samp({c}),7) AS {c}_std, count({c}) AS {c}_count' for c in ('centroid_x', 'length', 'width'))} FROM j GROUP BY game, team, state""")
def shape_by_possession(spark, sf_dir):
    return rounded(sh.shape_by_possession(sh.team_shape(trk(spark, sf_dir), hull=False), held(spark, sf_dir), ("centroid_x", "length", "width")), 7)


FRAMES, LEAST = 75, 10
WINDOWS = f"""{HELD}, {GK}, nb AS (SELECT game, period, frame, holder, CAST(floor((row_number() OVER (PARTITION BY game, period ORDER BY frame)-1)/{FRAMES}) AS INT) AS "window" FROM held),
wp AS (SELECT t.game, t.team, t.period, "window", CASE WHEN holder=t.team THEN 'in possession' ELSE 'out of possession' END AS state, t.player, avg(CASE WHEN t.team='away' THEN 105-x ELSE x END) AS x, avg(CASE WHEN t.team='away' THEN 68-y ELSE y END) AS y, count(x) AS seen, count(*) AS frames
  FROM trk t ANTI JOIN gk USING (game, team, player) JOIN nb ON t.game=nb.game AND t.frame=nb.frame WHERE holder<>'' GROUP BY ALL),
w9 AS (SELECT * FROM wp WHERE frames>={LEAST} AND seen::DOUBLE/frames>=0.9e0),
wt AS (SELECT w9.* FROM w9 JOIN (SELECT game, team, period, "window", state FROM w9 GROUP BY ALL HAVING count(*)=10) USING (game, team, period, "window", state))"""


def _windows(spark, sf_dir) -> DataFrame:
    return sh.window_positions(trk(spark, sf_dir), held(spark, sf_dir), FRAMES, LEAST)


@cat.add(f'{W}, {WINDOWS} SELECT game, team, period, "window", state, player, round(x,4) AS x, round(y,4) AS y, frames FROM wt')
def formation_positions(spark, sf_dir):
    return rounded(_windows(spark, sf_dir))


#: All splits of ten sorted depths into two to four runs, their spread by definition, and the silhouette of the best by definition.
LINES = f"""{W}, {WINDOWS}, fo_x AS (SELECT game, team, period, "window", state, max(frames) AS frames, list(x ORDER BY x, player) AS v, list(player ORDER BY x, player) AS who FROM wt GROUP BY ALL),
fo_c AS (SELECT [0, a, 10] AS c FROM range(1,10) r(a) UNION ALL SELECT [0, a, b, 10] FROM range(1,10) r(a), range(1,10) q(b) WHERE a<b UNION ALL SELECT [0, a, b, d, 10] FROM range(1,10) r(a), range(1,10) q(b), range(1,10) s(d) WHERE a<b AND b<d),
fo_p AS (SELECT fo_x.*, c, len(c)-1 AS k, list_transform(range(1, len(c)), lambda i: v[c[i]+1:c[i+1]]) AS parts FROM fo_x, fo_c),
fo_s AS (SELECT *, list_sum(list_transform(parts, lambda p: list_sum(list_transform(p, lambda x: power(x-list_avg(p),2))))) AS spread FROM fo_p),
fo_b AS (SELECT game, team, period, "window", state, frames, who, v, k, arg_min(c, (round(spread,9), c)) AS c, arg_min(parts, (round(spread,9), c)) AS parts FROM fo_s GROUP BY ALL),
fo_t AS (SELECT *, list_sum(list_transform(range(1, k+1), lambda i: list_sum(list_transform(parts[i], lambda x: CASE WHEN len(parts[i])=1 THEN 0 ELSE
  (list_min(list_transform(list_filter(range(1, k+1), lambda j: j<>i), lambda j: list_avg(list_transform(parts[j], lambda o: abs(x-o)))))-list_sum(list_transform(parts[i], lambda o: abs(x-o)))/(len(parts[i])-1))
  /greatest(list_min(list_transform(list_filter(range(1, k+1), lambda j: j<>i), lambda j: list_avg(list_transform(parts[j], lambda o: abs(x-o))))), list_sum(list_transform(parts[i], lambda o: abs(x-o)))/(len(parts[i])-1)) END))))/10 AS silhouette FROM fo_b),
fm AS (SELECT * FROM fo_t QUALIFY row_number() OVER (PARTITION BY game, team, period, "window", state ORDER BY round(silhouette,9) DESC, k)=1)"""


@cat.add(f"""{LINES} SELECT game, team, period, "window", state, frames, CAST(k AS INT) AS k, array_to_string(list_transform(parts, lambda p: len(p)), '-') AS formation, round(silhouette,4) AS silhouette, CAST(10 AS BIGINT) AS players FROM fm""")
def formation_windows(spark, sf_dir):
    rows = sh.formations(_windows(spark, sf_dir))
    return rounded(rows.groupBy("game", "team", "period", "window", "state", "k", "formation", "silhouette").agg(F.max("frames").alias("frames"), F.count(F.lit(1)).alias("players")))


@cat.add(f"""{LINES} SELECT game, team, period, "window", state, who[i] AS player, round(v[i],4) AS x, CAST(len(list_filter(c, lambda e: e<i))-1 AS INT) AS line FROM fm, range(1,11) r(i)""")
def formation_points(spark, sf_dir):
    return rounded(sh.formations(_windows(spark, sf_dir)).select("game", "team", "period", "window", "state", "player", "x", "line"))


@cat.add(f"""{W}, {WINDOWS}, c AS (SELECT team, state, concat('block-', CAST(count(*) FILTER (x<52.5) AS VARCHAR)) AS formation FROM wt GROUP BY game, team, period, "window", state),
n AS (SELECT team, state, formation, count(*) AS n FROM c GROUP BY ALL)
SELECT team, state, CAST(sum(n) AS BIGINT) AS windows, arg_min(formation, (-n, formation)) AS modal_formation, round(max(n)/sum(n),2) AS modal_share, count(*) AS distinct_formations FROM n GROUP BY team, state""")
def formation_reliability(spark, sf_dir):
    """Reliability of labels that SQL can also make: how many players are in the own half."""
    labels = _windows(spark, sf_dir).groupBy("game", "team", "period", "window", "state").agg(F.concat(F.lit("block-"), F.count_if(F.col("x") < 52.5).cast("string")).alias("formation"))
    return sh.reliability(labels)


#: Who is nearest along a row of cells, from pairs of players: from which cell on the right one of two is nearer.
CONTROL = f"""{W}, pl AS (SELECT game, frame, team, player, x, y FROM trk WHERE x IS NOT NULL AND y IS NOT NULL), gr AS (SELECT CAST(unnest(range(0,136)) AS INT) AS iy),
ln AS (SELECT pl.*, iy, x*x+((iy+0.5e0)*0.5e0-y)*((iy+0.5e0)*0.5e0-y) AS c FROM pl, gr),
pr AS (SELECT b.game, b.frame, b.iy, a.team AS lt, a.player AS lp, b.team AS rt, b.player AS rp, (b.team, b.player)<(a.team, a.player) AS tie, (b.c-a.c)/(2*(b.x-a.x))/0.5e0-0.5e0 AS k FROM ln a JOIN ln b ON a.game=b.game AND a.frame=b.frame AND a.iy=b.iy AND a.x<b.x),
cu AS (SELECT *, CASE WHEN tie THEN ceil(k) ELSE floor(k)+1 END AS cut FROM pr),
lo AS (SELECT game, frame, iy, rt AS team, rp AS player, max(cut) AS lo FROM cu GROUP BY ALL), hi AS (SELECT game, frame, iy, lt AS team, lp AS player, min(cut) AS hi FROM cu GROUP BY ALL),
gone AS (SELECT DISTINCT b.game, b.frame, b.iy, b.team, b.player FROM ln a JOIN ln b ON a.game=b.game AND a.frame=b.frame AND a.iy=b.iy AND a.x=b.x AND (a.c<b.c OR (a.c=b.c AND (a.team, a.player)<(b.team, b.player)))),
rn AS (SELECT game, frame, iy, team, player, greatest(coalesce(lo,0),0) AS start, least(coalesce(hi,210),210) AS stop FROM (SELECT * FROM ln ANTI JOIN gone USING (game, frame, iy, team, player)) LEFT JOIN lo USING (game, frame, iy, team, player) LEFT JOIN hi USING (game, frame, iy, team, player))"""


@cat.add(f"{CONTROL} SELECT game, frame, round(1-sum(CASE WHEN team='away' THEN stop-start ELSE 0 END)/sum(stop-start),4) AS home_share FROM rn WHERE start<stop GROUP BY game, frame")
def voronoi(spark, sf_dir):
    """Space control of every frame, by cells of half a metre."""
    return rounded(sh.control_of_frames(trk(spark, sf_dir), ("game", "frame")))


@cat.add(f"{W}, p AS (SELECT game, frame, team, player, x, y FROM trk WHERE frame=101 AND x IS NOT NULL AND y IS NOT NULL), g AS (SELECT a.ix, b.iy FROM (SELECT unnest(range(0,210)) AS ix) a, (SELECT unnest(range(0,136)) AS iy) b) SELECT game, frame, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, arg_min(team, (power(x-(ix+0.5e0)*0.5e0,2)+power(y-(iy+0.5e0)*0.5e0,2), team, player)) AS team FROM p, g GROUP BY ALL")
def frame_view(spark, sf_dir):
    return sh.control_cells(sh.control(trk(spark, sf_dir).where("frame = 101"), ("game", "frame"))).select("game", "frame", "ix", "iy", "team")
