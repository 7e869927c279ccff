"""Queries over match events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import events as e
from ..operators import grids, network
from ..operators import shots as s
from ..sources.projections import EV, ev, table
from .catalogue import Catalogue, rounded

cat = Catalogue()
PENALTY_XG = 0.76
W = f"WITH ev AS ({EV})"
#: Distance, angle and the fixed score, for DuckDB.
DIST = "sqrt((120-{x})*(120-{x})+(40-{y})*(40-{y}))"
ANGLE = "atan2(abs((120-{x})*(44-{y})-(36-{y})*(120-{x})), (120-{x})*(120-{x})+(36-{y})*(44-{y}))"
D, A = DIST.format(x="x", y="y"), ANGLE.format(x="x", y="y")
XG = f"1/(1+exp(0.12e0*{D}-1.5e0*{A}+0.5e0))"
MODELLED = "type='Shot' AND shot_type IS DISTINCT FROM 'Penalty' AND period<>5"
GOAL = "((type='Shot' AND shot_outcome='Goal' AND period<>5) OR type='Own Goal For')"
SHOTS = f"""{W}, pe AS (SELECT match_id, period, max(minute) AS e FROM ev WHERE period<=4 GROUP BY match_id, period),
sp AS (SELECT match_id, p.period FROM (SELECT DISTINCT match_id FROM pe) m, (VALUES (1),(2),(3),(4)) p(period)),
sh AS (SELECT sp.match_id, sp.period, coalesce(sum(coalesce(greatest(0, e - CASE sp.period WHEN 1 THEN 45 WHEN 2 THEN 90 WHEN 3 THEN 105 END),0)) OVER (PARTITION BY sp.match_id ORDER BY sp.period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS shift
  FROM sp LEFT JOIN pe ON sp.match_id=pe.match_id AND sp.period=pe.period),
sx AS (SELECT ev.match_id, idx, team, player, ev.period, minute, x, y, CASE WHEN shot_outcome='Goal' THEN 1 ELSE 0 END AS is_goal,
  CASE WHEN shot_type='Penalty' THEN {PENALTY_XG}e0 ELSE {XG} END AS xg, coalesce(shot_type='Penalty', FALSE) AS is_penalty, CAST(minute+coalesce(shift,0) AS INT) AS t
  FROM ev LEFT JOIN sh ON ev.match_id=sh.match_id AND ev.period=sh.period WHERE type='Shot' AND ev.period<>5)"""
NET = f"""{W}, fs AS (SELECT match_id, team, min(idx) AS first_sub FROM ev WHERE type='Substitution' GROUP BY match_id, team),
np AS (SELECT ev.* FROM ev LEFT JOIN fs ON ev.match_id=fs.match_id AND ev.team=fs.team WHERE type='Pass' AND pass_outcome IS NULL AND pass_recipient IS NOT NULL AND (first_sub IS NULL OR idx<first_sub)),
nodes AS (SELECT match_id, team, player, avg(x) AS x, avg(y) AS y, count(*) AS passes FROM np GROUP BY match_id, team, player),
edges AS (SELECT match_id, team, least(player,pass_recipient) AS a, greatest(player,pass_recipient) AS b, count(*) AS weight FROM np WHERE player<>pass_recipient GROUP BY ALL)"""


def shots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.shots_with_xg(ev(spark, sf_dir), PENALTY_XG)


@cat.add(f"""{SHOTS}, pg AS (SELECT player, team, count(*) AS passes, count(*) FILTER (pass_outcome IS NULL) AS passes_completed,
  count(*) FILTER (pass_outcome IS NULL AND coalesce(pass_type,'')<>'Goal Kick' AND coalesce({D}-{DIST.format(x='end_x', y='end_y')}>=10, FALSE)) AS progressive_passes,
  count(*) FILTER (coalesce(pass_shot_assist,FALSE) OR coalesce(pass_goal_assist,FALSE)) AS key_passes FROM ev WHERE type='Pass' GROUP BY player, team),
sg AS (SELECT player, team, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals, sum(xg) AS xg FROM sx GROUP BY player, team)
SELECT player, team, coalesce(passes,0) AS passes, coalesce(passes_completed,0) AS passes_completed, coalesce(progressive_passes,0) AS progressive_passes, coalesce(key_passes,0) AS key_passes,
  coalesce(shots,0) AS shots, coalesce(goals,0) AS goals, round(coalesce(xg,0),3) AS xg, round(coalesce(goals,0)-coalesce(xg,0),3) AS goals_minus_xg
FROM pg FULL JOIN sg USING (player, team)""")
def player_summary(spark, sf_dir):
    return e.player_summary(ev(spark, sf_dir), shots_of(spark, sf_dir)).orderBy(F.desc("xg"), "player", "team")


@cat.add(f"""{W}, sd AS (SELECT *, CAST(2*coalesce(sum(CASE WHEN {GOAL} THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, team ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)
  - coalesce(sum(CASE WHEN {GOAL} THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS INT) AS score_diff FROM ev)
SELECT s.match_id, s.idx, s.team, s.player, s.period, s.x, s.y, round({DIST.format(x='s.x', y='s.y')},4) AS distance, round({ANGLE.format(x='s.x', y='s.y')},4) AS angle,
  CAST(coalesce(s.first_time,FALSE) AS INT) AS first_time, CAST(coalesce(p.pass_through_ball,FALSE) AS INT) AS follows_through_ball, CAST(coalesce(p.pass_cross,FALSE) AS INT) AS follows_cross,
  CAST(coalesce(s.under_pressure,FALSE) AS INT) AS under_pressure, s.minute, s.score_diff,
  CASE WHEN s.shot_body_part='Head' THEN 'Head' WHEN s.shot_body_part LIKE '%Foot%' THEN 'Foot' ELSE 'Other' END AS body_part,
  CASE WHEN s.shot_type IN ('Open Play','Free Kick') THEN s.shot_type ELSE 'Other' END AS shot_type, CASE WHEN s.shot_outcome='Goal' THEN 1 ELSE 0 END AS is_goal,
  s.competition_id, s.season_id, s.play_pattern, round(s.sb_xg,4) AS sb_xg
FROM sd s LEFT JOIN ev p ON p.type='Pass' AND p.idx=s.key_pass_id WHERE s.type='Shot' AND s.shot_type IS DISTINCT FROM 'Penalty' AND s.period<>5""")
def shot_features(spark, sf_dir):
    return rounded(s.dataset(ev(spark, sf_dir)).drop(*s.FREEZE_FEATURES))


@cat.add(f"""{W} SELECT count(*) AS all_shots, count(*) FILTER (shot_type='Penalty' AND period<>5) AS penalties, count(*) FILTER (period=5) AS shootout_kicks,
  count(*) FILTER (shot_type IS DISTINCT FROM 'Penalty' AND period<>5) AS modelled FROM ev WHERE type='Shot'""")
def exclusion_counts(spark, sf_dir):
    return s.exclusion_counts(ev(spark, sf_dir))


@cat.add(f"{W} SELECT count(*) AS penalties, round(avg(CASE WHEN shot_outcome='Goal' THEN 1 ELSE 0 END),4) AS rate FROM ev WHERE type='Shot' AND shot_type='Penalty' AND period<>5")
def penalty_rate(spark, sf_dir):
    return rounded(e.penalty_rate(ev(spark, sf_dir)))


@cat.add(f"""{W}, g AS (SELECT match_id, team, idx FROM ev WHERE {GOAL})
SELECT s.match_id, s.idx, s.team, CAST(coalesce(sum(CASE WHEN g.team=s.team THEN 1 WHEN g.team IS NOT NULL THEN -1 END),0) AS INT) AS score_diff
FROM ev s LEFT JOIN g ON g.match_id=s.match_id AND g.idx<s.idx WHERE s.type='Shot' GROUP BY s.match_id, s.idx, s.team""")
def score_diff(spark, sf_dir):
    return s.with_score_diff(ev(spark, sf_dir)).where("type = 'Shot'").select("match_id", "idx", "team", "score_diff")


@cat.add(f"""{W} SELECT s.match_id, s.idx, CAST(coalesce(p.pass_through_ball,FALSE) AS INT) AS follows_through_ball, CAST(coalesce(p.pass_cross,FALSE) AS INT) AS follows_cross
FROM ev s LEFT JOIN ev p ON p.type='Pass' AND p.idx=s.key_pass_id WHERE s.type='Shot'""")
def key_pass_flags(spark, sf_dir):
    rows = ev(spark, sf_dir)
    return s.with_key_pass(s.shot_table(rows), rows).select("match_id", "idx", "follows_through_ball", "follows_cross")


def _cone(px: str, py: str) -> str:
    side = lambda ax, ay, bx, by: f"(({px}-({bx}))*(({ay})-({by}))-(({ax})-({bx}))*({py}-({by})))"
    sides = [side("x", "y", "120", "36"), side("120", "36", "120", "44"), side("120", "44", "x", "y")]
    return f"NOT (({' OR '.join(f'{v}<0' for v in sides)}) AND ({' OR '.join(f'{v}>0' for v in sides)}))"


@cat.add(f"""{W}, n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY idx) AS rn FROM ev),
j AS (SELECT s.match_id, s.idx, s.x, s.y, f.x AS px, f.y AS py, f.idx%3=0 AS mate, f.idx%4=0 AS gk, f.rn AS frn FROM n s LEFT JOIN n f ON f.match_id=s.match_id AND f.rn BETWEEN s.rn-5 AND s.rn-1
  WHERE s.type='Shot' AND s.shot_type IS DISTINCT FROM 'Penalty' AND s.period<>5),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, idx, (NOT mate AND gk) ORDER BY frn) AS kn FROM j)
SELECT match_id, idx, CASE WHEN count(px)>0 THEN CAST(count(*) FILTER (NOT mate AND NOT gk AND {_cone('px', 'py')}) AS DOUBLE) END AS ff_defenders_in_cone,
  CAST(max(CASE WHEN NOT mate AND gk AND kn=1 THEN CASE WHEN {_cone('px', 'py')} THEN 1 ELSE 0 END END) AS DOUBLE) AS ff_gk_in_cone,
  round(max(CASE WHEN NOT mate AND gk AND kn=1 THEN {DIST.format(x='px', y='py')} END),4) AS ff_gk_distance,
  round(min(CASE WHEN NOT mate AND NOT gk THEN sqrt((px-x)*(px-x)+(py-y)*(py-y)) END),4) AS ff_nearest_defender
FROM k GROUP BY match_id, idx""")
def freeze_frame(spark, sf_dir):
    rows = s.modelled(s.dense_freeze_frames(ev(spark, sf_dir)))
    return rounded(rows.select("match_id", "idx", *[c.alias(n) for n, c in s.freeze_frame(F.col("frame"), F.col("x"), F.col("y")).items()]))


@cat.add(f"{SHOTS} SELECT match_id, idx, team, period, minute, t FROM sx")
def match_time(spark, sf_dir):
    return shots_of(spark, sf_dir).select("match_id", "idx", "team", "period", "minute", "t")


@cat.add(f"{SHOTS} SELECT match_id, idx, team, player, period, minute, x, y, is_goal, round(xg,4) AS xg, is_penalty, t FROM sx")
def shots_with_xg(spark, sf_dir):
    return rounded(shots_of(spark, sf_dir)).select("match_id", "idx", "team", "player", "period", "minute", "x", "y", "is_goal", "xg", "is_penalty", "t")


@cat.add(f"""{SHOTS} SELECT match_id, team, CAST(t AS DOUBLE) AS t, round(sum(xg) OVER (PARTITION BY match_id, team ORDER BY idx ROWS UNBOUNDED PRECEDING),4) AS total FROM sx
UNION ALL SELECT DISTINCT match_id, team, 0e0, 0e0 FROM sx
UNION ALL SELECT a.match_id, a.team, b.t, round(a.total,4) FROM (SELECT match_id, team, sum(xg) AS total FROM sx GROUP BY match_id, team) a JOIN (SELECT match_id, greatest(90e0, max(t)+1e0) AS t FROM sx GROUP BY match_id) b USING (match_id)""")
def xg_race(spark, sf_dir):
    return rounded(e.xg_race(shots_of(spark, sf_dir)).drop("step"))


@cat.add(f"""{SHOTS} SELECT match_id, idx, team, round(CASE WHEN team='A' THEN 120-x ELSE x END,4) AS x, round(CASE WHEN team='A' THEN 80-y ELSE y END,4) AS y, round(40+1800*xg,2) AS area, is_goal FROM sx""")
def shot_map(spark, sf_dir):
    fx, fy = g.flip_events(F.col("x"), F.col("y"))
    first = F.col("team") == "A"
    rows = shots_of(spark, sf_dir).select("match_id", "idx", "team", F.when(first, fx).otherwise(F.col("x")).alias("x"), F.when(first, fy).otherwise(F.col("y")).alias("y"), F.round(40 + 1800 * F.col("xg"), 2).alias("area"), "is_goal")
    return rounded(rows)


TOUCH = "type IN ('Pass','Ball Receipt*','Carry','Shot') AND ball_receipt_outcome IS NULL"


@cat.add(f"{W} SELECT match_id, idx, team, player, x, y FROM ev WHERE {TOUCH}")
def touches(spark, sf_dir):
    return e.touches(ev(spark, sf_dir)).select("match_id", "idx", "team", "player", "x", "y")


@cat.add(f"{W} SELECT team, CAST(least(23, floor(x/5)) AS INT) AS ix, CAST(least(15, floor(y/5)) AS INT) AS iy, count(*) AS n FROM ev WHERE {TOUCH} AND x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 80 GROUP BY ALL")
def touch_grid(spark, sf_dir):
    return grids.histogram(e.touches(ev(spark, sf_dir)), (120.0, 80.0), (24, 16), ("team",))


KERNEL = "(SELECT d.d, exp(-0.5e0*d.d*d.d/2.25e0)/(SELECT sum(exp(-0.5e0*z.z*z.z/2.25e0)) FROM (SELECT unnest(range(-6,7)) AS z) z) AS w FROM (SELECT unnest(range(-6,7)) AS d) d)"


@cat.add(f"""{W}, h AS (SELECT team, CAST(least(23, floor(x/5)) AS INT) AS ix, CAST(least(15, floor(y/5)) AS INT) AS iy, count(*)::DOUBLE AS n FROM ev WHERE {TOUCH} AND x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 80 GROUP BY ALL),
kx AS {KERNEL},
a0 AS (SELECT team, iy, o.o AS ix, sum(n*w) AS n FROM (SELECT unnest(range(0,24)) AS o) o, kx, h WHERE h.ix = CASE WHEN o.o+d<0 THEN -(o.o+d)-1 WHEN o.o+d>23 THEN 47-(o.o+d) ELSE o.o+d END GROUP BY ALL),
b0 AS (SELECT team, ix, o.o AS iy, sum(n*w) AS n FROM (SELECT unnest(range(0,16)) AS o) o, kx, a0 WHERE a0.iy = CASE WHEN o.o+d<0 THEN -(o.o+d)-1 WHEN o.o+d>15 THEN 31-(o.o+d) ELSE o.o+d END GROUP BY ALL)
SELECT team, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(n/sum(n) OVER (PARTITION BY team),6) AS share FROM b0""")
def touch_heatmap(spark, sf_dir):
    grid = grids.histogram(e.touches(ev(spark, sf_dir)), (120.0, 80.0), (24, 16), ("team",))
    return rounded(grids.blurred(grid, (24, 16), 1.5, ("team",)), 6)


@cat.add(f"{NET} SELECT match_id, team, player, round(x,4) AS x, round(y,4) AS y, passes FROM nodes")
def pass_nodes(spark, sf_dir):
    return rounded(e.pass_nodes(ev(spark, sf_dir)))


@cat.add(f"{NET} SELECT * FROM edges")
def pass_edges(spark, sf_dir):
    return e.pass_edges(ev(spark, sf_dir))


@cat.add(f"""{NET}, u AS (SELECT match_id, team, a AS player, weight FROM edges UNION ALL SELECT match_id, team, b, weight FROM edges UNION ALL SELECT match_id, team, player, NULL FROM nodes)
SELECT match_id, team, player, count(weight) AS degree, CAST(coalesce(sum(weight),0) AS BIGINT) AS strength FROM u GROUP BY match_id, team, player""")
def network_degree(spark, sf_dir):
    rows = ev(spark, sf_dir)
    return e.degrees(e.pass_nodes(rows), e.pass_edges(rows))


@cat.add(f"""{NET} SELECT match_id, team, a, b, weight, round(p.x,4) AS ax, round(p.y,4) AS ay, round(q.x,4) AS bx, round(q.y,4) AS by, round(0.5e0+0.6e0*weight,4) AS width
FROM edges JOIN (SELECT match_id, team, player AS a, x, y FROM nodes) p USING (match_id, team, a) JOIN (SELECT match_id, team, player AS b, x, y FROM nodes) q USING (match_id, team, b) WHERE weight>=3""")
def pass_network_plot(spark, sf_dir):
    rows = ev(spark, sf_dir)
    return rounded(e.drawn_edges(e.pass_nodes(rows), e.pass_edges(rows)).select("match_id", "team", "a", "b", "weight", "ax", "ay", "bx", "by", "width"))


@cat.add(f"{W} SELECT match_id, team, min(idx) AS first_sub, arg_min(minute, idx) AS sub_minute FROM ev WHERE type='Substitution' GROUP BY match_id, team")
def first_subs(spark, sf_dir):
    return e.first_subs(ev(spark, sf_dir))


#: Lengths of shortest paths by rounds of relaxing, numbers of shortest paths by their numbers of edges, and from these the share through each player.
PATHS = NET.replace("WITH ", "WITH RECURSIVE ", 1) + """, bw_u AS (SELECT match_id, team, a AS player, weight FROM edges UNION ALL SELECT match_id, team, b, weight FROM edges UNION ALL SELECT match_id, team, player, NULL FROM nodes),
bw_n AS (SELECT match_id, team, player, count(weight) AS degree, coalesce(sum(weight),0)::BIGINT AS strength FROM bw_u GROUP BY ALL), bw_c AS (SELECT match_id, team, count(*) AS players FROM bw_n GROUP BY ALL),
bw_e AS (SELECT match_id, team, a AS f, b AS t, 1e0/weight AS w FROM edges UNION ALL SELECT match_id, team, b, a, 1e0/weight FROM edges),
bw_d AS (SELECT 0 AS i, match_id, team, player AS s, player AS t, 0e0 AS d FROM bw_n UNION ALL
 SELECT i+1, match_id, team, s, t, min(d) FROM (SELECT i, match_id, team, s, t, d FROM bw_d UNION ALL SELECT i, bw_d.match_id, bw_d.team, s, bw_e.t, d+w FROM bw_d JOIN bw_e ON bw_e.match_id=bw_d.match_id AND bw_e.team=bw_d.team AND bw_e.f=bw_d.t) WHERE i<(SELECT max(players) FROM bw_c) GROUP BY i, match_id, team, s, t),
bw_l AS (SELECT match_id, team, s, t, d FROM bw_d WHERE i=(SELECT max(i) FROM bw_d)),
bw_h AS (SELECT 0 AS h, match_id, team, player AS s, player AS t, 1e0 AS n FROM bw_n UNION ALL
 SELECT h+1, q.match_id, q.team, q.s, bw_e.t, sum(n) FROM bw_h q JOIN bw_e ON bw_e.match_id=q.match_id AND bw_e.team=q.team AND bw_e.f=q.t JOIN bw_l x ON x.match_id=q.match_id AND x.team=q.team AND x.s=q.s AND x.t=q.t JOIN bw_l y ON y.match_id=q.match_id AND y.team=q.team AND y.s=q.s AND y.t=bw_e.t WHERE abs(x.d+w-y.d)<1e-9 GROUP BY h, q.match_id, q.team, q.s, bw_e.t),
bw_p AS (SELECT match_id, team, s, t, d, sum(n) AS n FROM bw_h JOIN bw_l USING (match_id, team, s, t) GROUP BY ALL),
bw_b AS (SELECT x.match_id, x.team, x.t AS player, sum(x.n*y.n/z.n) AS through FROM bw_p x JOIN bw_p y ON y.match_id=x.match_id AND y.team=x.team AND y.s=x.t JOIN bw_p z ON z.match_id=x.match_id AND z.team=x.team AND z.s=x.s AND z.t=y.t WHERE x.s<>x.t AND y.s<>y.t AND x.s<>y.t AND abs(x.d+y.d-z.d)<1e-9 GROUP BY ALL)"""


@cat.add(f"""{PATHS}, bw AS (SELECT match_id, team, player, degree, strength, round(CASE WHEN players>2 THEN coalesce(through,0e0)/((players-1)*(players-2)) ELSE 0e0 END,4) AS betweenness FROM bw_n JOIN bw_c USING (match_id, team) LEFT JOIN bw_b USING (match_id, team, player))
SELECT *, CAST(row_number() OVER (PARTITION BY match_id, team ORDER BY betweenness DESC, strength DESC, player) AS INT) AS place FROM bw""")
def network_betweenness(spark, sf_dir):
    """Partners, passes and betweenness of a team's players, the most central first: by betweenness, then by passes."""
    rows = ev(spark, sf_dir)
    nodes, edges = e.pass_nodes(rows), e.pass_edges(rows)
    joined = e.degrees(nodes, edges).join(network.betweenness(nodes, edges), ["match_id", "team", "player"])
    place = F.row_number().over(Window.partitionBy("match_id", "team").orderBy(F.desc("betweenness"), F.desc("strength"), "player"))
    return joined.withColumn("place", place)


@cat.add(f"{SHOTS} SELECT match_id, team, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals, round(sum(xg),4) AS xg FROM sx GROUP BY match_id, team")
def team_totals(spark, sf_dir):
    return rounded(e.team_totals(shots_of(spark, sf_dir)))


@cat.add(f"{W} SELECT type, count(*) AS n FROM ev GROUP BY type")
def type_counts(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


@cat.add(f"{W} SELECT shot_outcome, count(*) AS n FROM ev WHERE type='Shot' GROUP BY shot_outcome")
def outcome_counts(spark, sf_dir):
    return s.shot_table(ev(spark, sf_dir)).groupBy("shot_outcome").agg(F.count(F.lit(1)).alias("n"))


@cat.add(f"""{W} SELECT count(x) AS n, round(avg(x),4) AS mean_x, round(stddev_samp(x),4) AS std_x, round(min(x),4) AS min_x, round(quantile_cont(x,0.25),4) AS q1_x, round(quantile_cont(x,0.5),4) AS median_x, round(quantile_cont(x,0.75),4) AS q3_x, round(max(x),4) AS max_x,
  round(avg(y),4) AS mean_y, round(stddev_samp(y),4) AS std_y, round(min(y),4) AS min_y, round(quantile_cont(y,0.25),4) AS q1_y, round(quantile_cont(y,0.5),4) AS median_y, round(quantile_cont(y,0.75),4) AS q3_y, round(max(y),4) AS max_y FROM ev WHERE type='Shot'""")
def describe_xy(spark, sf_dir):
    stats = [F.count("x").alias("n")]
    for c in ("x", "y"):
        stats += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
        stats += [F.percentile(c, q).alias(f"{n}_{c}") for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return rounded(s.shot_table(ev(spark, sf_dir)).agg(*stats))


@cat.add(f"{W} SELECT round(avg(CASE WHEN x>=102 AND y BETWEEN 18 AND 62 THEN 1e0 ELSE 0e0 END),4) AS box_share FROM ev WHERE type='Shot'")
def box_share(spark, sf_dir):
    inside = (F.col("x") >= 102) & F.col("y").between(18, 62)
    return rounded(s.shot_table(ev(spark, sf_dir)).agg(F.avg(inside.cast("double")).alias("box_share")))


@cat.add(f"{W} SELECT round(avg({D}),4) AS mean_distance, round(quantile_cont({D},0.5),4) AS median_distance FROM ev WHERE type='Shot'")
def distance_stats(spark, sf_dir):
    d = g.shot_distance(F.col("x"), F.col("y"))
    return rounded(s.shot_table(ev(spark, sf_dir)).agg(F.avg(d).alias("mean_distance"), F.percentile(d, 0.5).alias("median_distance")))


@cat.add(f"{W} SELECT idx, round(x/120*105,4) AS mx, round(y/80*68,4) AS my, round(x/120*105*1e0,4) AS ux, round(y/80*68*1e0,4) AS uy, round(x/120*120,4) AS ex, round(y/80*80,4) AS ey FROM ev")
def coord_rescale(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    mx, my = g.events_to_metres(x, y)
    ux, uy = g.unit_to_metres(x / 120, y / 80)
    ex, ey = g.unit_to_events(x / 120, y / 80)
    return rounded(ev(spark, sf_dir).select("idx", mx.alias("mx"), my.alias("my"), ux.alias("ux"), uy.alias("uy"), ex.alias("ex"), ey.alias("ey")))


@cat.add(f"""{W} SELECT match_id, team, player, round(sum({XG}),4) AS xg, count(*) AS shots FROM ev WHERE {MODELLED} GROUP BY match_id, team, player ORDER BY round(sum({XG}),4) DESC, match_id, team, player LIMIT 10""")
def topk_xg(spark, sf_dir):
    rows = s.modelled(ev(spark, sf_dir)).withColumn("xg", s.closed_form_xg(F.col("x"), F.col("y")))
    return rounded(rows.groupBy("match_id", "team", "player").agg(F.sum("xg").alias("xg"), F.count(F.lit(1)).alias("shots"))).orderBy(F.desc("xg"), "match_id", "team", "player").limit(10)


@cat.add(f"""{SHOTS}, g AS (SELECT player, team, count(*) AS shots, round(sum(is_goal)-sum(xg),3) AS goals_minus_xg FROM sx GROUP BY player, team)
SELECT * FROM g WHERE shots>=10 ORDER BY goals_minus_xg DESC, player, team LIMIT 10""")
def topk_goals_minus_xg(spark, sf_dir):
    rows = shots_of(spark, sf_dir).groupBy("player", "team").agg(F.count(F.lit(1)).alias("shots"), F.round(F.sum("is_goal") - F.sum("xg"), 3).alias("goals_minus_xg"))
    return rows.where("shots >= 10").orderBy(F.desc("goals_minus_xg"), "player", "team").limit(10)


@cat.add(f"{W} SELECT match_id, arg_min(idx, idx) AS idx, arg_min(player, idx) AS player FROM ev WHERE type='Shot' GROUP BY match_id")
def topk_first_shot(spark, sf_dir):
    return s.shot_table(ev(spark, sf_dir)).groupBy("match_id").agg(F.min("idx").alias("idx"), F.min_by("player", "idx").alias("player"))


@cat.add(f"{W}, c AS (SELECT match_id, team, player, count(*) AS passes FROM ev WHERE type='Pass' GROUP BY ALL) SELECT DISTINCT ON (match_id, team) match_id, team, player, passes FROM c ORDER BY match_id, team, passes DESC, player")
def topk_passer(spark, sf_dir):
    counts = ev(spark, sf_dir).where("type = 'Pass'").groupBy("match_id", "team", "player").agg(F.count(F.lit(1)).alias("passes"))
    best = F.min_by(F.struct("player", "passes"), F.struct(-F.col("passes"), "player")).alias("b")
    return counts.groupBy("match_id", "team").agg(best).select("match_id", "team", "b.player", "b.passes")


@cat.add(f"""{W}, s AS (SELECT * FROM ev WHERE {MODELLED} UNION ALL SELECT * FROM ev WHERE type='Shot' AND shot_type='Penalty' AND period<>5 UNION ALL SELECT * FROM ev WHERE type='Own Goal For')
SELECT type, count(*) AS n, count(DISTINCT match_id) AS matches FROM s GROUP BY type""")
def union_variants(spark, sf_dir):
    rows = ev(spark, sf_dir)
    both = s.modelled(rows).drop("is_goal").unionByName(s.penalties(rows).drop("is_goal")).unionByName(rows.where("type = 'Own Goal For'"))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("matches"))


@cat.add(f"{W} SELECT DISTINCT ON (match_id, team) match_id, team, idx, player FROM ev ORDER BY match_id, team, idx")
def distinct_keys(spark, sf_dir):
    """The first row of each key, not just any."""
    rows = ev(spark, sf_dir).groupBy("match_id", "team").agg(F.min_by(F.struct("idx", "player"), "idx").alias("r"))
    return rows.select("match_id", "team", "r.idx", "r.player")


@cat.add(f"""{W} SELECT player, CAST(regexp_extract(player,'([0-9]+)$',1) AS INT) AS number, count(*) AS n, count(*) FILTER (type='Pass') AS "Pass", count(*) FILTER (type='Shot') AS "Shot", count(*) FILTER (type='Carry') AS "Carry" FROM ev GROUP BY player""")
def pivot_players(spark, sf_dir):
    rows = ev(spark, sf_dir)
    wide = rows.groupBy("player").pivot("type", ["Pass", "Shot", "Carry"]).count().na.fill(0)
    return rows.groupBy("player").agg(F.count(F.lit(1)).alias("n")).join(wide, "player").withColumn("number", text.shirt_number(F.col("player")))


@cat.add(f"{W} SELECT match_id, idx, CASE WHEN shot_type='Free Kick' THEN 1e0 ELSE 0e0 END AS free_kick, CASE WHEN shot_type='Open Play' THEN 1e0 ELSE 0e0 END AS open_play FROM ev WHERE type='Shot'")
def one_hot(spark, sf_dir):
    """Unseen and missing categories are zero in all columns."""
    rows = s.shot_table(ev(spark, sf_dir))
    return rows.select("match_id", "idx", *[F.coalesce(F.col("shot_type") == v, F.lit(False)).cast("double").alias(n) for v, n in (("Free Kick", "free_kick"), ("Open Play", "open_play"))])


@cat.add(f"{W} SELECT idx, CASE type WHEN 'Shot' THEN 3 WHEN 'Pass' THEN 1 ELSE 0 END AS weight FROM ev")
def map_default(spark, sf_dir):
    weights = F.create_map(F.lit("Shot"), F.lit(3), F.lit("Pass"), F.lit(1))
    return ev(spark, sf_dir).select("idx", F.coalesce(F.try_element_at(weights, F.col("type")), F.lit(0)).alias("weight"))


@cat.add(f"""{W}, a AS (SELECT match_id, avg(x) AS mean_x, avg(y) AS mean_y, count(*)::DOUBLE AS n FROM ev GROUP BY match_id)
SELECT match_id, metric, round(value,4) AS value FROM a UNPIVOT (value FOR metric IN (mean_x, mean_y, n))""")
def unpivot_metrics(spark, sf_dir):
    rows = ev(spark, sf_dir).groupBy("match_id").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count(F.lit(1)).cast("double").alias("n"))
    return rounded(rows.unpivot("match_id", ["mean_x", "mean_y", "n"], "metric", "value"))


@cat.add(f"{W} SELECT match_id, count(*) AS shots, count(DISTINCT player) AS players, CAST(sum(CASE WHEN shot_outcome='Goal' THEN 1 ELSE 0 END) AS BIGINT) AS goals, round(avg(CASE WHEN shot_outcome='Goal' THEN 1 ELSE 0 END),4) AS goal_rate FROM ev WHERE {MODELLED} GROUP BY match_id")
def dataset_summary(spark, sf_dir):
    return rounded(s.modelled(ev(spark, sf_dir)).groupBy("match_id").agg(F.count(F.lit(1)).alias("shots"), F.count_distinct("player").alias("players"), F.sum("is_goal").alias("goals"), F.avg("is_goal").alias("goal_rate")))


@cat.add(f"""{W}, t AS (SELECT match_id, count(*) FILTER (type='Shot') AS n FROM ev GROUP BY match_id)
SELECT round(avg(n),4) AS mean, round(quantile_cont(n,0.5),4) AS median, min(n) AS least, max(n) AS most FROM t""")
def shots_per_match(spark, sf_dir):
    """Matches without shots count as 0."""
    rows = ev(spark, sf_dir)
    counts = s.shot_table(rows).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    filled = rows.select("match_id").distinct().join(counts, "match_id", "left").na.fill(0)
    return rounded(filled.agg(F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.min("n").alias("least"), F.max("n").alias("most")))


@cat.add(f"{W} SELECT CAST(floor(least(x,119.999)/12) AS INT) AS ix, CAST(floor(least(y,79.999)/10) AS INT) AS iy, count(*) AS n FROM ev WHERE type='Shot' AND x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 80 GROUP BY ALL")
def location_density(spark, sf_dir):
    return grids.histogram(s.shot_table(ev(spark, sf_dir)), (120.0, 80.0), (10, 8))


@cat.add("SELECT c_custkey, CASE WHEN length(c_name)-length(replace(c_name,' ',''))=0 THEN c_name ELSE concat(substr(c_name,1,1),'. ',regexp_extract(c_name,'([^ ]+)$',1)) END AS short FROM customer")
def short_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.short_name(F.col("c_name")).alias("short"))


@cat.add("SELECT c_custkey, coalesce(n_name, c_name) AS shown FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey AND n_nationkey%2=0")
def nickname_coalesce(spark, sf_dir):
    nicks = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(nicks, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", text.display_name(F.col("n_name"), F.col("c_name")).alias("shown"))


@cat.add("SELECT o_orderkey, concat(r_name,': ',n_name,' (',CAST(CAST(o_orderdate AS DATE) AS VARCHAR),')') AS label FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def match_label(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("o_orderkey", F.concat("r_name", F.lit(": "), "n_name", F.lit(" ("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(")")).alias("label"))


@cat.add("SELECT CAST(year(o_orderdate) AS INT) AS season, o_orderstatus AS competition, count(*) AS matches FROM orders GROUP BY ALL")
def matches_per_season(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("competition"))
    return rows.groupBy("season", "competition").agg(F.count(F.lit(1)).alias("matches"))


@cat.add("SELECT year(o_orderdate)::INT AS season, count(*) AS n, count(CASE WHEN year(o_orderdate)%2=0 THEN o_totalprice END) AS priced FROM orders GROUP BY ALL")
def all_matches_union(spark, sf_dir):
    """Seasons stacked by name; the odd ones lack a column, which is null there."""
    from ..sources.readers import stacked

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"))
    both = stacked([rows.where("season % 2 = 0"), rows.where("season % 2 = 1").drop("o_totalprice")])
    return both.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("priced"))


@cat.add("SELECT (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey%5<>0)) AS only_left, 0::BIGINT AS only_right, (SELECT count(*) FROM orders WHERE o_orderkey%5=0)=0 AS equal")
def set_equality(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = rows.where("o_orderkey % 5 <> 0")
    left = rows.exceptAll(part).agg(F.count(F.lit(1)).alias("only_left"))
    right = part.exceptAll(rows).agg(F.count(F.lit(1)).alias("only_right"))
    return left.crossJoin(right).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


@cat.add("SELECT o_orderstatus AS competition, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_orderstatus")
def topk_latest_match(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("competition")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
