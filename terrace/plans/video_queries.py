"""Queries over detection tables and result tables; the inputs are projections of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import report
from ..operators import camera
from ..operators import video as v
from ..sources import readers
from ..sources.projections import TRK, table, trk
from ..sources.scratch import shared_path
from .catalogue import Catalogue, rounded
from .match_queries import SHOTS, shots_of

cat = Catalogue()
SIGNAL = """SELECT CAST(floor(event_id/2.0e3) AS INT) AS clip, CAST(row_number() OVER (PARTITION BY floor(event_id/2.0e3) ORDER BY event_id)-1 AS INT) AS frame,
 CASE WHEN value>200 THEN 0.5e0 ELSE 0.1e0 END AS hist_dist, CASE WHEN row_number() OVER (PARTITION BY floor(event_id/2.0e3) ORDER BY event_id)=1 THEN 0e0 ELSE value/4e0 END AS diff FROM events"""
DET = """SELECT event_id AS det_id, CAST(floor(event_id/1000) AS INT) AS segment, CAST(floor(event_id/10) AS INT) AS frame, CAST(CASE WHEN event_id%29=0 THEN -1 ELSE event_id%10 END AS INT) AS track_id,
 CAST(CASE WHEN event_id%17=0 THEN 32 ELSE 0 END AS INT) AS cls, 600+20*(event_id%10)+user_id%7 AS x1, 300+10*(event_id%10)+user_id%5 AS y1, 620+20*(event_id%10)+user_id%7 AS x2, 350+10*(event_id%10)+user_id%5 AS y2,
 event_id%13<>0 AS on_grass, CASE WHEN event_id%11=0 THEN NULL ELSE (CASE WHEN event_id%2=0 THEN 200 ELSE 60 END)+user_id%9 END*1e0 AS "L", 120e0+user_id%4 AS a, 130e0+user_id%3 AS b FROM events"""
H = [0.05, 0.001, -10.0, 0.002, -0.06, 40.0, 0.00001, 0.00002, 1.0]
MAP = "({0}*fx+{1}*fy+{2})/({6}*fx+{7}*fy+{8}) AS \"X\", ({3}*fx+{4}*fy+{5})/({6}*fx+{7}*fy+{8}) AS \"Y\"".format(*[f"({h:.8f}::DOUBLE)" for h in H])
W = f"WITH sig AS ({SIGNAL}), det AS ({DET}), ft AS (SELECT *, (x1+x2)/2 AS fx, CASE WHEN cls=32 THEN (y1+y2)/2 ELSE y2 END AS fy FROM det), pos AS (SELECT *, {MAP}, CASE WHEN track_id%2=0 THEN 'light' ELSE 'dark' END AS team FROM ft)"
CUTS = """, k AS (SELECT *, CASE WHEN frame>0 THEN diff END AS known FROM sig),
nb AS (SELECT a.clip, a.frame, a.hist_dist, a.known, median(b.known) AS med, count(b.known) AS n FROM k a LEFT JOIN k b ON a.clip=b.clip AND b.frame BETWEEN a.frame-6 AND a.frame+6 AND b.frame<>a.frame GROUP BY ALL),
cuts AS (SELECT clip, frame FROM nb WHERE hist_dist>0.35 OR (known IS NOT NULL AND n>0 AND known>10 AND known>3.5*greatest(med,1)))"""
SEGS = f"""{CUTS}, cl AS (SELECT clip, CAST(count(*) AS INT) AS n_frames FROM sig GROUP BY clip), st AS (SELECT DISTINCT clip, frame AS start FROM cuts UNION SELECT clip, 0 FROM cl),
seg AS (SELECT * FROM (SELECT clip, CAST(start AS INT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY clip ORDER BY start), n_frames) AS INT) AS "end" FROM st JOIN cl USING (clip)) WHERE "end"-start>=25)"""


def _sql(spark, sf_dir, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM events", "FROM {events}").replace('"L"', "L"), events=table(spark, sf_dir, "events"))


def signal(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, SIGNAL)


def detections(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, DET)


def positions(spark, sf_dir) -> DataFrame:
    det = detections(spark, sf_dir)
    maps = det.select("frame").distinct().withColumn("h", F.array(*[F.lit(h) for h in H]))
    return v.players_to_pitch(det, maps).withColumn("team", F.when(F.col("track_id") % 2 == 0, "light").otherwise("dark"))


def segments_of(spark, sf_dir) -> DataFrame:
    rows = signal(spark, sf_dir)
    clips = rows.groupBy("clip").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
    return v.segments(v.cuts(rows), clips)


@cat.add(f"{W}{CUTS} SELECT clip, frame FROM cuts")
def cuts(spark, sf_dir):
    return v.cuts(signal(spark, sf_dir))


@cat.add(f'{W}{SEGS} SELECT clip, start, "end" FROM seg')
def segments(spark, sf_dir):
    return segments_of(spark, sf_dir)


@cat.add(f'{W}{SEGS} SELECT sig.clip, frame, start FROM sig JOIN seg ON sig.clip=seg.clip AND frame>=start AND frame<"end"')
def frame_segment(spark, sf_dir):
    frames = v.frames_of(segments_of(spark, sf_dir))
    return signal(spark, sf_dir).select("clip", "frame").join(frames, ["clip", "frame"])


@cat.add(f'{W}{SEGS} SELECT clip, start, "end" FROM seg WHERE start<=200 AND "end">200')
def point_in_segment(spark, sf_dir):
    return v.containing(segments_of(spark, sf_dir), 200)


@cat.add(f"""{W}, pp AS (SELECT * FROM det WHERE cls=0 AND on_grass AND track_id>=0), sp AS (SELECT segment, unnest(range(first, last+1)) AS frame FROM (SELECT segment, min(frame) AS first FROM pp GROUP BY segment) JOIN (SELECT segment, max(frame) AS last FROM det GROUP BY segment) USING (segment)),
c AS (SELECT sp.segment, sp.frame, count(DISTINCT track_id) AS n FROM sp LEFT JOIN pp ON sp.segment=pp.segment AND sp.frame=pp.frame GROUP BY ALL),
f AS (SELECT segment, avg(n) AS a, quantile_cont(n,0.5) AS med, count(*) AS frames FROM c GROUP BY segment), tr AS (SELECT segment, count(*) AS ids, avg(l) AS m FROM (SELECT segment, track_id, count(DISTINCT frame) AS l FROM pp GROUP BY ALL) GROUP BY segment),
r AS (SELECT segment, count(DISTINCT CASE WHEN cls=32 THEN frame END) AS ball, count(*) FILTER (cls=0 AND NOT on_grass) AS removed FROM det GROUP BY segment)
SELECT segment, round(a,4) AS players_per_frame, round(med,4) AS median_players, frames, ids, round(m,4) AS mean_track_length, removed, round(ids/nullif(med,0),4) AS ids_per_player, round(ball/frames,4) AS ball_share FROM f JOIN tr USING (segment) JOIN r USING (segment)""")
def segment_quality(spark, sf_dir):
    det = detections(spark, sf_dir)
    return rounded(v.segment_quality(det, det.groupBy("segment").agg(F.max("frame").alias("last"))))


@cat.add(f"{W} SELECT segment, frame, (count(*)>=5 AND quantile_cont((y2-y1)/720e0,0.5)<0.28) AS wide FROM det WHERE cls=0 AND on_grass GROUP BY segment, frame")
def wide_shot(spark, sf_dir):
    return v.wide_shots(detections(spark, sf_dir), 720.0)


@cat.add(f"""{W} SELECT segment, track_id, round(quantile_cont("L",0.5),4) AS "L", round(quantile_cont(a,0.5),4) AS a, round(quantile_cont(b,0.5),4) AS b, count(*) AS n FROM det WHERE cls=0 AND on_grass AND "L" IS NOT NULL AND track_id>=0 GROUP BY segment, track_id HAVING count(*)>=5""")
def track_colours(spark, sf_dir):
    return rounded(v.track_colours(detections(spark, sf_dir)))


#: Track colours of clips of four segments, three starts a clip (the ends by each colour axis), thirty rounds of means, the start with the least inertia.
KITS = f"""WITH RECURSIVE det AS ({DET}), tc AS (SELECT CAST(floor(segment/4) AS INT) AS clip, segment, track_id, quantile_cont("L",0.5) AS lc, quantile_cont(a,0.5) AS ac, quantile_cont(b,0.5) AS bc FROM det WHERE cls=0 AND on_grass AND "L" IS NOT NULL AND track_id>=0 GROUP BY segment, track_id HAVING count(*)>=5),
st AS (SELECT clip, 0 AS s, arg_min((lc,ac,bc),(lc,lc,ac,bc)) AS p, arg_max((lc,ac,bc),(lc,lc,ac,bc)) AS q FROM tc GROUP BY clip UNION ALL SELECT clip, 1, arg_min((lc,ac,bc),(ac,lc,ac,bc)), arg_max((lc,ac,bc),(ac,lc,ac,bc)) FROM tc GROUP BY clip
 UNION ALL SELECT clip, 2, arg_min((lc,ac,bc),(bc,lc,ac,bc)), arg_max((lc,ac,bc),(bc,lc,ac,bc)) FROM tc GROUP BY clip),
r AS (SELECT 0 AS i, clip, s, p[1] AS l0, p[2] AS a0, p[3] AS b0, q[1] AS l1, q[2] AS a1, q[3] AS b1 FROM st UNION ALL
 SELECT i+1, clip, s, coalesce(round(avg(lc) FILTER (NOT far),9),l0), coalesce(round(avg(ac) FILTER (NOT far),9),a0), coalesce(round(avg(bc) FILTER (NOT far),9),b0), coalesce(round(avg(lc) FILTER (far),9),l1), coalesce(round(avg(ac) FILTER (far),9),a1), coalesce(round(avg(bc) FILTER (far),9),b1)
 FROM (SELECT r.*, lc, ac, bc, power(lc-l1,2)+power(ac-a1,2)+power(bc-b1,2)<power(lc-l0,2)+power(ac-a0,2)+power(bc-b0,2) AS far FROM r JOIN tc USING (clip)) WHERE i<30 GROUP BY i, clip, s, l0, a0, b0, l1, a1, b1),
ds AS (SELECT r.*, segment, track_id, power(lc-l0,2)+power(ac-a0,2)+power(bc-b0,2) AS d0, power(lc-l1,2)+power(ac-a1,2)+power(bc-b1,2) AS d1 FROM r JOIN tc USING (clip) WHERE i=30),
be AS (SELECT clip, arg_min(s, (round(inertia,6), s)) AS s, max(n) AS n FROM (SELECT clip, s, sum(least(d0,d1)) AS inertia, count(*) AS n FROM ds GROUP BY clip, s) GROUP BY clip),
nr AS (SELECT ds.*, n, round(sqrt(least(d0,d1)),9) AS d, median(round(sqrt(least(d0,d1)),9)) OVER (PARTITION BY clip) AS med FROM ds JOIN be USING (clip, s))"""


@cat.add(f"{KITS} SELECT clip, segment, track_id, CASE WHEN n<4 OR d>2.5e0*med THEN 'other' WHEN (l0>=l1)=(d0<=d1) THEN 'light' ELSE 'dark' END AS team FROM nr")
def track_teams(spark, sf_dir):
    """Kits of each clip, four segments of it."""
    colours = v.track_colours(detections(spark, sf_dir)).withColumn("clip", F.floor(F.col("segment") / 4).cast("int"))
    return v.track_teams(colours, by=("clip",))


#: A camera that stands elsewhere in each clip: landmarks all over the image, with their places on the pitch.
LAND = "SELECT CAST(floor(event_id/500) AS INT) AS clip, event_id AS mark, (event_id*37)%1280+user_id%11*1e-1 AS ix, (event_id*53)%720+user_id%7*1e-1 AS iy, CAST(floor(event_id/500) AS INT)%9*3e0 AS pan FROM events"
PLACED = "SELECT *, ({0}*(ix+pan)+{1}*iy+{2})/({6}*(ix+pan)+{7}*iy+{8}) AS px, ({3}*(ix+pan)+{4}*iy+{5})/({6}*(ix+pan)+{7}*iy+{8}) AS py FROM l".format(*[f"CAST({h:.8f} AS DOUBLE)" for h in H])


@cat.add(f"""WITH l AS ({LAND}), m AS ({PLACED}) SELECT clip, count(*) AS n, 0e0 AS worst, 0e0 AS rms, round(max(px),3) AS most_x, round(min(py),3) AS least_y FROM m GROUP BY clip""")
def homographies(spark, sf_dir):
    """A matrix for each clip from its landmarks: how far off it is, and the ends of what it sees."""
    marks = _sql(spark, sf_dir, f"WITH l AS ({LAND}) {PLACED}")
    maps = v.fit_homographies(marks)
    x, y = g.apply_h(F.col("h"), F.col("ix"), F.col("iy"))
    seen = marks.select("clip", "mark", "ix", "iy").join(maps, "clip").select("clip", "mark", x.alias("x"), y.alias("y"))
    errors = v.landmark_errors(marks, maps).groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("error"), 4).alias("worst"), F.round(F.sqrt(F.avg(F.col("error") * F.col("error"))), 4).alias("rms"))
    return errors.join(seen.groupBy("clip").agg(F.round(F.max("x"), 3).alias("most_x"), F.round(F.min("y"), 3).alias("least_y")), "clip")


@cat.add(f"{W} SELECT team, count(DISTINCT segment*100+track_id) AS tracks FROM pos WHERE track_id>=0 GROUP BY team")
def team_counts(spark, sf_dir):
    return positions(spark, sf_dir).where("track_id >= 0").select("team", "segment", "track_id").distinct().groupBy("team").agg(F.count(F.lit(1)).alias("tracks"))


@cat.add(f"{W}, q AS (SELECT segment%2 AS tracker, count(DISTINCT segment*100+track_id)/count(DISTINCT frame)::DOUBLE AS ratio FROM det WHERE track_id>=0 GROUP BY ALL) SELECT CAST(tracker AS INT) AS tracker, round(ratio,4) AS ratio FROM q ORDER BY ratio, tracker LIMIT 1")
def tracker_choice(spark, sf_dir):
    rows = detections(spark, sf_dir).where("track_id >= 0").groupBy((F.col("segment") % 2).alias("tracker"))
    return rounded(rows.agg((F.count_distinct("segment", "track_id") / F.count_distinct("frame")).alias("ratio")).orderBy("ratio", "tracker").limit(1))


@cat.add(f"{W} SELECT det_id, round(fx,4) AS fx, round(fy,4) AS fy FROM ft")
def feet_points(spark, sf_dir):
    x, y = g.feet(F.col("cls"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return rounded(detections(spark, sf_dir).select("det_id", x.cast("double").alias("fx"), y.cast("double").alias("fy")))


@cat.add(f'{W} SELECT det_id, round("X",4) AS "X", round("Y",4) AS "Y" FROM pos')
def players_to_pitch(spark, sf_dir):
    return rounded(positions(spark, sf_dir).select("det_id", "X", "Y"))


@cat.add(f'{W} SELECT det_id, round(({H[0]:.8f}::DOUBLE*x1+{H[1]:.8f}::DOUBLE*y1+{H[2]:.8f}::DOUBLE)/({H[6]:.8f}::DOUBLE*x1+{H[7]:.8f}::DOUBLE*y1+{H[8]:.8f}::DOUBLE),4) AS hx FROM det')
def apply_homography(spark, sf_dir):
    hx, _ = g.apply_h(F.array(*[F.lit(h) for h in H]), F.col("x1"), F.col("y1"))
    return rounded(detections(spark, sf_dir).select("det_id", hx.alias("hx")))


@cat.add(f"""{W}, r AS (SELECT clip, frame, CASE WHEN frame%97=96 THEN NULL ELSE CASE WHEN diff<100 THEN 5e0 ELSE 1e0 END END AS score FROM sig),
s AS (SELECT *, coalesce(quantile_cont(score,0.5) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)>=3, FALSE) OR frame=100 AS good FROM r),
i AS (SELECT *, sum(CASE WHEN good AND NOT lg THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame) AS isl FROM (SELECT *, coalesce(lag(good) OVER (PARTITION BY clip ORDER BY frame), FALSE) AS lg FROM s))
SELECT clip, start, "end" FROM (SELECT clip, isl, min(frame) AS start, max(frame) AS "end" FROM i WHERE good GROUP BY ALL) WHERE start<=100 AND "end">=100""")
def valid_window(spark, sf_dir):
    score = F.when(F.col("frame") % 97 == 96, F.lit(None).cast("double")).when(F.col("diff") < 100, 5.0).otherwise(1.0)
    return v.valid_window(signal(spark, sf_dir).select("clip", "frame", score.alias("score")), 100)


@cat.add(f"""{W}, st AS (SELECT clip, frame, diff FROM sig UNION ALL SELECT clip, CAST(max(frame)+1 AS INT), 0e0 FROM sig GROUP BY clip HAVING max(frame)>=100),
pn AS (SELECT clip, frame, coalesce(sum(diff/1e2) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0e0) AS s FROM st),
tx AS (SELECT pn.clip, pn.frame, pn.s-r.s AS t FROM pn JOIN pn r ON r.clip=pn.clip AND r.frame=100)
SELECT clip, frame, round(({H[0]:.8f}::DOUBLE*t+{H[2]:.8f}::DOUBLE)/({H[6]:.8f}::DOUBLE*t+1e0),4) AS shift FROM tx""")
def h_chain(spark, sf_dir):
    """Cameras that pan by a little each frame, chained to the reference frame."""
    steps = signal(spark, sf_dir).select("clip", "frame", F.array(*[F.lit(x) for x in (1.0, 0.0)], -F.col("diff") / 100, *[F.lit(x) for x in (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]).alias("h"))
    return camera.camera_maps(steps, 100, H).select("clip", "frame", F.round(F.col("h")[2], 4).alias("shift"))


MARKS_SQL = " UNION ALL ".join(
    [f"SELECT '{n}' AS name, k, {a}::DOUBLE+({c}::DOUBLE-{a}::DOUBLE)*k/10e0 AS x, {b}::DOUBLE+({d}::DOUBLE-{b}::DOUBLE)*k/10e0 AS y FROM ks" for n, a, b, c, d in v.pitch_lines()]
    + [f"SELECT '{n}', k, {x}::DOUBLE+{r}::DOUBLE*cos({a}::DOUBLE+({b}::DOUBLE-({a}::DOUBLE))*k/10e0), {y}::DOUBLE+{r}::DOUBLE*sin({a}::DOUBLE+({b}::DOUBLE-({a}::DOUBLE))*k/10e0) FROM ks" for n, x, y, r, a, b in v.pitch_arcs()]
)


@cat.add(f"{W}, ks AS (SELECT CAST(unnest(range(0,11)) AS INT) AS k), mk AS ({MARKS_SQL}) SELECT segment, name, k, round(({H[0]:.8f}::DOUBLE*x+{H[1]:.8f}::DOUBLE*y+{H[2]:.8f}::DOUBLE)/({H[6]:.8f}::DOUBLE*x+{H[7]:.8f}::DOUBLE*y+{H[8]:.8f}::DOUBLE),4) AS px FROM (SELECT DISTINCT segment FROM det), mk")
def pitch_overlay(spark, sf_dir):
    """All markings of the pitch, straight and round, mapped by each segment's matrix."""
    segments = detections(spark, sf_dir).select("segment").distinct()
    lines = F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(float(x)).alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), ends)]) for n, *ends in v.pitch_lines()])
    arcs = F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(float(x)).alias(c) for c, x in zip(("cx", "cy", "r", "a0", "a1"), of)]) for n, *of in v.pitch_arcs()])
    out = []
    for marks, samples in ((lines, v.line_samples), (arcs, v.arc_samples)):
        named = segments.select("segment", F.explode(marks).alias("m")).select(F.struct("segment", "m.name").alias("name"), *[F.col(f"m.{c}") for c in (("x0", "y0", "x1", "y1") if marks is lines else ("cx", "cy", "r", "a0", "a1"))])
        out.append(samples(named, 11))
    px, _ = g.apply_h(F.array(*[F.lit(h) for h in H]), F.col("x"), F.col("y"))
    return rounded(out[0].unionByName(out[1]).select("name.segment", "name.name", "k", px.alias("px")))


@cat.add(f"""{W}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY det_id) AS rn FROM pos WHERE cls=0 AND track_id>=0) WHERE rn=1),
gp AS (SELECT *, frame-lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM f), ok AS (SELECT track_id FROM gp GROUP BY track_id HAVING count(*)>=50 AND coalesce(max(gap),0)<=3)
SELECT track_id, count(*) AS frames FROM f JOIN ok USING (track_id) GROUP BY track_id""")
def track_prefilter(spark, sf_dir):
    return v.usable_tracks(positions(spark, sf_dir)).groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"))


def _sg(c: str) -> str:
    terms = [f"({i})*{'lead' if i > 0 else 'lag'}({c},{abs(i)}) OVER w" for i in range(-5, 6) if i]
    second = [f"({i * i - 10})*" + (f"{'lead' if i > 0 else 'lag'}({c},{abs(i)}) OVER w" if i else c) for i in range(-5, 6)]
    return f"({' + '.join(terms)})/110e0 AS a1_{c}, ({' + '.join(second)})/858e0 AS a2_{c}"


def _edge(c: str) -> str:
    return f"CASE WHEN i<6 THEN first_value(a1_{c} IGNORE NULLS) OVER w2+2*(i-6)*first_value(a2_{c} IGNORE NULLS) OVER w2 WHEN i>n-5 THEN last_value(a1_{c} IGNORE NULLS) OVER w2+2*(i-(n-5))*last_value(a2_{c} IGNORE NULLS) OVER w2 ELSE a1_{c} END"


@cat.add(f"""{W}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY det_id) AS rn FROM pos WHERE cls=0 AND track_id>=0) WHERE rn=1),
gp AS (SELECT *, frame-lag(frame) OVER w AS gap, lead(frame) OVER w AS nf, lead("X") OVER w AS nx, lead("Y") OVER w AS ny FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
ok AS (SELECT track_id FROM gp GROUP BY track_id HAVING count(*)>=50 AND coalesce(max(gap),0)<=3),
de AS (SELECT track_id, ff.k AS f, "X"+CASE WHEN ff.k=frame THEN 0 ELSE (nx-"X")*(ff.k-frame)/(nf-frame) END AS x, "Y"+CASE WHEN ff.k=frame THEN 0 ELSE (ny-"Y")*(ff.k-frame)/(nf-frame) END AS y FROM gp JOIN ok USING (track_id), unnest(range(frame, coalesce(nf, frame+1))) AS ff(k)),
sg AS (SELECT *, {_sg('x')}, {_sg('y')}, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n FROM de WINDOW w AS (PARTITION BY track_id ORDER BY f)),
sp AS (SELECT track_id, sqrt(power(({_edge('x')})*25,2)+power(({_edge('y')})*25,2)) AS speed FROM sg WINDOW w2 AS (PARTITION BY track_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tm AS (SELECT track_id, arg_min(team, (-n, team)) AS team FROM (SELECT track_id, team, count(*) AS n FROM f GROUP BY ALL) GROUP BY track_id)
SELECT track_id, team, count(*) AS frames, round(count(*)/25e0,1) AS seconds, round(sum(speed/25),2) AS distance_m, round(avg(speed),3) AS mean_speed_ms, round(max(speed),3) AS max_speed_ms, max(speed)>12 AS implausible_speed FROM sp JOIN tm USING (track_id) GROUP BY track_id, team""")
def track_motion(spark, sf_dir):
    out = v.track_motion(positions(spark, sf_dir), 25.0)
    return out.select("track_id", "team", "frames", "seconds", F.round("distance_m", 2).alias("distance_m"), F.round("mean_speed_ms", 3).alias("mean_speed_ms"), F.round("max_speed_ms", 3).alias("max_speed_ms"), "implausible_speed")


TRAIL = 'count(*) OVER w AS trail_length, round(first_value("X") OVER w,4) AS tail_x FROM pos WHERE track_id>=0 WINDOW w AS (PARTITION BY segment, track_id ORDER BY frame, det_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)'


@cat.add(f"{W} SELECT det_id, {TRAIL}")
def trails(spark, sf_dir):
    return v.trails(positions(spark, sf_dir)).select("det_id", F.size("trail").cast("long").alias("trail_length"), F.round(F.col("trail")[0]["X"], 4).alias("tail_x"))


@cat.add(f"{W}, t AS (SELECT det_id, {TRAIL}) SELECT det_id, round(tail_x*2e0+1,3) AS px FROM t WHERE trail_length>1")
def project_trails(spark, sf_dir):
    """The oldest place of each trail of two or more, mapped by a matrix."""
    rows = v.trails(positions(spark, sf_dir)).where(F.size("trail") > 1)
    px, _ = g.apply_h(F.array(*[F.lit(x) for x in (2.0, 0.0, 1.0, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0)]), F.round(F.col("trail")[0]["X"], 4), F.lit(0.0))
    return rows.select("det_id", F.round(px, 3).alias("px"))


@cat.add(f'{W} SELECT det_id, CAST(round(("X"+5)*8) AS INT) AS px, CAST(round((68-"Y"+5)*8) AS INT) AS py FROM pos WHERE "X" BETWEEN -5 AND 110 AND "Y" BETWEEN -5 AND 73')
def radar(spark, sf_dir):
    return v.radar(positions(spark, sf_dir)).select("det_id", "px", "py")


@cat.add('SELECT n_nationkey AS line, CAST(k.k AS INT) AS k, round(n_nationkey+(n_regionkey*10-n_nationkey)*k.k/4e0,4) AS x, round(n_regionkey*1e0,4) AS y FROM nation, (SELECT unnest(range(0,5)) AS k) k')
def line_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_nationkey").alias("x0"), F.col("n_regionkey").alias("y0"), (F.col("n_regionkey") * 10).alias("x1"), F.col("n_regionkey").alias("y1"))
    return rounded(v.line_samples(rows, 5).select(F.col("name").alias("line"), "k", "x", "y"))


@cat.add(f"{W} SELECT 'colours' AS section, CAST(segment AS VARCHAR) AS subject, count(*) FILTER (\"L\" IS NOT NULL) AS n FROM det GROUP BY segment UNION ALL SELECT 'teams', team, count(DISTINCT segment*100+track_id) FROM pos WHERE track_id>=0 GROUP BY team UNION ALL SELECT 'tracking', team, count(x) FROM ({TRK}) GROUP BY team")
def report_tables(spark, sf_dir):
    """Sections of a report under each other, each with its name in front."""
    colours = detections(spark, sf_dir).groupBy(F.col("segment").cast("string").alias("subject")).agg(F.count("L").alias("n")).select(F.lit("colours").alias("section"), "subject", "n")
    teams = positions(spark, sf_dir).where("track_id >= 0").groupBy(F.col("team").alias("subject")).agg(F.count_distinct("segment", "track_id").alias("n")).select(F.lit("teams").alias("section"), "subject", "n")
    tracking = trk(spark, sf_dir).groupBy(F.col("team").alias("subject")).agg(F.count("x").alias("n")).select(F.lit("tracking").alias("section"), "subject", "n")
    return colours.unionByName(teams).unionByName(tracking)


@cat.add(f"""{SHOTS} SELECT team, '{{"team":"'||team||'","shots":'||count(*)||',"goals":'||sum(is_goal)||'}}' AS document FROM sx GROUP BY team""")
def result_json(spark, sf_dir):
    totals = shots_of(spark, sf_dir).groupBy("team").agg(F.count(F.lit(1)).alias("shots"), F.sum("is_goal").alias("goals"))
    return totals.select("team", F.to_json(F.struct("*")).alias("document"))


@cat.add(f"""{SHOTS} SELECT '| match_id | team | shots | xg |' AS row UNION ALL SELECT '|---|---|---|---|' UNION ALL SELECT '| '||match_id||' | '||team||' | '||count(*)||' | '||printf('%.4f', round(sum(xg),4))||' |' FROM sx GROUP BY match_id, team""")
def md_table(spark, sf_dir):
    totals = rounded(shots_of(spark, sf_dir).groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("shots"), F.sum("xg").alias("xg")))
    return report.markdown_rows(totals, ["match_id", "team"])
