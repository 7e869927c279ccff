"""Small tables with answers worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrace.functions import geometry as g
from terrace.functions import text
from terrace.operators import events as e
from terrace.operators import metrics as m
from terrace.operators import network, possession, shape
from terrace.operators import shots as s
from terrace.operators import tracking as t
from terrace.operators import camera
from terrace.operators import video as v
from terrace.sources import loaders, readers

EVENT = "match_id int, idx long, period int, minute int, team string, player string, type string, x double, y double, shot_outcome string, shot_type string, pass_outcome string, pass_recipient string, ball_receipt_outcome string"


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_geometry(spark):
    rows = spark.createDataFrame([(114.0, 32.0), (96.0, 40.0), (120.0, 52.0), (120.0, 38.0)], "x double, y double")
    got = values(rows.select(g.shot_distance(F.col("x"), F.col("y")).alias("d"), g.shot_angle(F.col("x"), F.col("y")).alias("a")), "d", "a")
    assert [d for d, _ in got] == pytest.approx([10, 24, 12, 2])
    assert [a for _, a in got[1:]] == pytest.approx([2 * math.atan(4 / 24), 0, math.pi])


def test_cone(spark):
    """From (100, 44) the cone at x = 110 reaches from y = 40 to 44."""
    rows = spark.createDataFrame([(110.0, 42.0), (110.0, 39.0), (110.0, 44.0), (95.0, 44.0)], "px double, py double")
    assert [r[0] for r in values(rows.select(g.in_shot_cone(F.col("px"), F.col("py"), F.lit(100.0), F.lit(44.0)).alias("c")), "c")] == [True, False, True, False]


def test_coordinates(spark):
    row = spark.range(1).select(*[F.array(*c).alias(n) for n, c in (("m", g.events_to_metres(F.lit(60.0), F.lit(40.0))), ("u", g.unit_to_metres(F.lit(0.5), F.lit(0.5))), ("f", g.flip_events(F.lit(120.0), F.lit(40.0))))]).first()
    assert row["m"] == [52.5, 34.0] and row["u"] == [52.5, 34.0] and row["f"] == [0.0, 40.0]


def test_names(spark):
    rows = spark.createDataFrame([("Ann", None), ("Ann Maria Lee", ""), ("Ann Lee", "Annie")], "name string, nick string")
    assert [r[0] for r in values(rows.select(text.display_name(F.col("nick"), F.col("name")).alias("n")), "n")] == ["Ann", "A. Lee", "Annie"]


@pytest.fixture()
def match(spark):
    rows = [
        (1, 1, 1, 5, "A", "a", "Shot", 110.0, 40.0, "Saved", "Open Play", None, None, None),
        (1, 2, 1, 9, "B", "b", "Shot", 110.0, 40.0, "Goal", "Penalty", None, None, None),
        (1, 3, 1, 20, "A", "a", "Shot", 112.0, 40.0, "Goal", None, None, None, None),
        (1, 4, 2, 50, "A", None, "Own Goal For", None, None, None, None, None, None, None),
        (1, 5, 2, 60, "A", "c", "Shot", 100.0, 30.0, "Saved", "Free Kick", None, None, None),
        (1, 6, 5, 120, "B", "b", "Shot", 108.0, 40.0, "Goal", "Penalty", None, None, None),
    ]
    return spark.createDataFrame(rows, EVENT)


def test_exclusions_and_score(match):
    assert tuple(s.exclusion_counts(match).first()) == (5, 1, 1, 3)
    diff = dict(values(s.with_score_diff(match).where("type = 'Shot'"), "idx", "score_diff"))
    assert diff == {1: 0, 2: 0, 3: -1, 5: 1, 6: -1}
    assert e.penalty_rate(match).first()["rate"] == 1.0


def test_match_time(spark):
    rows = [(1, 1, 1, 47, "A", "a", "Pass"), (1, 2, 2, 45, "A", "a", "Pass"), (1, 3, 2, 96, "A", "a", "Pass"), (1, 4, 3, 91, "A", "a", "Pass"), (1, 5, 5, 120, "A", "a", "Pass")]
    events = spark.createDataFrame(rows, "match_id int, idx long, period int, minute int, team string, player string, type string")
    assert dict(values(e.with_match_time(events, events), "idx", "t")) == {1: 47, 2: 47, 3: 98, 4: 99, 5: 120}


def test_progressive_and_key_pass(spark):
    rows = [(60.0, 40.0, 90.0, 40.0, None, None, True, None), (60.0, 40.0, 90.0, 40.0, "Incomplete", None, None, True), (60.0, 40.0, 90.0, 40.0, None, "Goal Kick", None, None), (60.0, 40.0, 65.0, 40.0, None, None, None, None), (60.0, 40.0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, end_x double, end_y double, pass_outcome string, pass_type string, pass_shot_assist boolean, pass_goal_assist boolean")
    assert values(df.select(e.progressive().alias("p"), e.key_pass().alias("k")), "p", "k") == [(True, True), (False, True), (False, False), (False, False), (False, False)]


def test_pass_network(spark):
    p = lambda i, a, b, o=None: (1, i, 1, 1, "T", a, "Pass", 10.0 * i, 40.0, None, None, o, b, None)
    rows = [p(1, "A", "B"), p(2, "B", "A"), p(3, "A", "C", "Incomplete"), p(4, "A", "C"), (1, 10, 1, 7, "T", "B", "Substitution", *[None] * 7), p(11, "A", "B")]
    events = spark.createDataFrame(rows, EVENT)
    edges, nodes = e.pass_edges(events), e.pass_nodes(events)
    assert {(a, b): w for a, b, w in values(edges, "a", "b", "weight")} == {("A", "B"): 2, ("A", "C"): 1}
    assert e.first_subs(events).first()["sub_minute"] == 7
    found = {r["player"]: (r["degree"], r["strength"]) for r in e.degrees(nodes, edges).collect()}
    assert found == {"A": (2, 3), "B": (1, 2), "C": (1, 1)}
    between = dict(values(network.betweenness(nodes, edges), "player", "betweenness"))
    assert between == {"A": 1.0, "B": 0.0, "C": 0.0}


def test_betweenness_of_a_square():
    found = network.betweenness_of(list("abcd"), [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0)])
    assert found == pytest.approx(dict.fromkeys("abcd", 1 / 6))


def test_touches(spark):
    """Each type that counts as a touch, and some that don't."""
    kinds = ["Pass", "Ball Receipt*", "Carry", "Dribble", "Shot", "Miscontrol", "Dispossessed", "Clearance", "Interception", "Ball Recovery", "Block", "Pressure", "Duel"]
    rows = [(1, i, 1, i, "A", "a", k, 10.0, 10.0, None, None, None, None, None) for i, k in enumerate(kinds)]
    rows.append((1, 99, 1, 1, "A", "a", "Ball Receipt*", 10.0, 10.0, None, None, None, None, "Incomplete"))
    assert {r["idx"] for r in e.touches(spark.createDataFrame(rows, EVENT)).collect()} == set(range(10))


def test_freeze_frame(spark):
    schema = "x double, y double, frame array<struct<px:double,py:double,teammate:boolean,is_gk:boolean>>"
    rows = spark.createDataFrame([(110.0, 40.0, [(115.0, 40.0, False, False), (118.0, 40.0, False, True), (112.0, 40.0, True, False)]), (110.0, 40.0, None)], schema)
    got = rows.select(*[c.alias(n) for n, c in s.freeze_frame(F.col("frame"), F.col("x"), F.col("y")).items()]).collect()
    assert tuple(got[0]) == (1.0, 1.0, 2.0, 5.0) and tuple(got[1]) == (None,) * 4


def test_metrics(spark):
    rows = spark.createDataFrame([(y, 0.25) for y in [0, 0, 0, 1] * 25], "y int, p double")
    assert m.score_all(rows).first()["log_loss"] == pytest.approx(0.562335, abs=1e-6)
    curve = m.reliability(rows)
    assert curve.count() == 1 and m.calibration_error(curve).first()["ece"] == pytest.approx(0)
    assert m.auc(rows).first()["auc"] == 0.5
    ranked = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.9)], "y int, p double")
    assert m.auc(ranked).first()["auc"] == pytest.approx(3.5 / 4)
    assert m.auc(ranked.where("y = 1")).first()["auc"] is None


def track(spark, xs, period=None, y=30.0):
    rows = [(1, 1 if period is None else period[i], i + 1, i / 25, "home", "Player1", x, None if x is None else y) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "game int, period int, frame int, time_s double, team string, player string, x double, y double")


def test_despike_repairs_a_spike_and_keeps_a_jump(spark):
    xs = [60 - 0.08 * i for i in range(150)]
    xs[70] -= 9
    out = [r["x"] for r in t.despike(track(spark, xs)).orderBy("frame").collect()]
    assert None not in out and out[70] == pytest.approx(54.4, abs=0.2)
    jump = track(spark, [30.0 if i < 60 else 65.0 for i in range(120)])
    assert t.repair(jump, F.col("frame").isin(60, 61)).where("left").count() == 2
    still = track(spark, [7.0] * 90)
    assert t.repair(still, F.col("frame").between(40, 64)).where("left").count() == 0
    assert t.repair(still, F.col("frame").between(40, 65)).where("left").count() == 26


def test_kinematics(spark):
    out = t.smooth_kinematics(track(spark, [0.32 * i for i in range(150)])).where("speed IS NOT NULL").agg(F.min("speed"), F.max("speed"), F.max("accel"), F.count(F.lit(1))).first()
    assert out[0] == pytest.approx(8) and out[1] == pytest.approx(8) and out[2] == pytest.approx(0, abs=1e-6) and out[3] == 138
    gap = [None if 60 <= i < 65 else i / 25 for i in range(150)]
    null = {r["frame"] - 1 for r in t.smooth_kinematics(track(spark, gap)).where("speed IS NULL").collect()}
    assert null == {*range(6), *range(54, 71), *range(144, 150)}
    halves = [2.0 if i < 70 else 90.0 for i in range(140)]
    assert t.smooth_kinematics(track(spark, halves, [1] * 70 + [2] * 70)).agg(F.max("speed")).first()[0] == pytest.approx(0, abs=1e-9)


def test_sprints(spark):
    rows = spark.createDataFrame([(1, "away", "Player4", i, 7.5 if 20 <= i < 60 else 3.0) for i in range(90)], "game int, team string, player string, frame int, speed double")
    assert t.sprints(rows).first()["sprints"] == 1
    assert t.sprints(rows.where("frame < 44 OR frame >= 60")).count() == 0  # 24 frames are less than a second


def test_possession(spark):
    frames = spark.createDataFrame([(1, 1, f) for f in range(1, 13)], "game int, period int, frame int")
    feed = spark.createDataFrame([(1, "RECOVERY", "away", 2, 1), (1, "SHOT", "home", 5, 2), (1, "BALL OUT", "home", 9, 3), (1, "CHALLENGE", "away", 11, 4)], "game int, type string, team string, start_frame int, seq int")
    held = [r["holder"] for r in possession.possession(frames, feed).orderBy("frame").collect()]
    assert held == [""] + ["away"] * 3 + ["home"] * 4 + [""] * 4


def test_control_of_two_players(spark):
    pos = spark.createDataFrame([(1, "home", "a", 20.0, 34.0), (1, "away", "b", 60.0, 34.0)], "game int, team string, player string, x double, y double")
    assert shape.control_share(shape.control(pos)).first()["home_share"] == pytest.approx(40 / 105, abs=0.01)


def test_video(spark):
    clips = spark.createDataFrame([(1, 120), (2, 120)], "clip int, n_frames int")
    cuts = spark.createDataFrame([(1, 40), (1, 80), (2, 10)], "clip int, frame int")
    assert sorted(values(v.segments(cuts, clips), "clip", "start", "end")) == [(1, 0, 40), (1, 40, 80), (1, 80, 120), (2, 10, 120)]
    scores = spark.createDataFrame([(1, f, None if f == 107 else 5.0 if 100 <= f <= 110 else 1.0) for f in range(90, 121)], "clip int, frame int, score double")
    assert values(v.valid_window(scores, 105), "start", "end") == [(100, 110)]
    pos = spark.createDataFrame([(i, 1, i, 0, 0.2 * i, 30.0, "light") for i in range(100)] + [(1000 + i, 2, i, 0, 1.0, 1.0, "dark") for i in range(20)], "det_id long, track_id int, frame int, cls int, X double, Y double, team string")
    motion = v.track_motion(pos, 25.0).collect()
    assert [r["track_id"] for r in motion] == [1] and motion[0]["mean_speed_ms"] == pytest.approx(5.0, abs=0.05) and not motion[0]["implausible_speed"]
    h, errors = v.fit_homography([(0, 0), (100, 0), (100, 50), (0, 50)], [(0, 0), (105, 0), (105, 68), (0, 68)])
    assert max(errors) < 1e-6 and h[0] == pytest.approx(1.05)
    colours = spark.createDataFrame([(1, i, 200.0 + i % 3, 120.0, 130.0) for i in range(10)] + [(1, 10 + i, 60.0 + i % 3, 120.0, 130.0) for i in range(10)] + [(1, 30, 130.0, 160.0, 90.0)], "segment int, track_id int, L double, a double, b double")
    teams = dict(values(v.track_teams(colours), "track_id", "team"))
    assert {teams[i] for i in range(10)} == {"light"} and {teams[10 + i] for i in range(10)} == {"dark"} and teams[30] == "other"


def test_kits_of_many_clips(spark):
    """Clips differ in their kits; a clip of three tracks, a null clip, and equal colours."""
    rows = [(1, 0, i, 200.0 + i % 3, 120.0, 130.0) for i in range(6)] + [(1, 1, i, 60.0 + i % 2, 120.0, 130.0) for i in range(6)] + [(1, 1, 9, 130.0, 220.0, 20.0)]
    rows += [(2, 5, i, 100.0 - 40 * (i % 2) + i % 3, 120.0, 90.0) for i in range(8)] + [(3, 7, i, 50.0 * i, 1.0, 1.0) for i in range(3)] + [(None, 8, i, 50.0 * (i % 2), 1.0, 1.0) for i in range(4)] + [(4, 9, i, 80.0, 80.0, 80.0) for i in range(5)]
    colours = spark.createDataFrame(rows, "clip int, segment int, track_id int, L double, a double, b double")
    got = {(r["clip"], r["segment"], r["track_id"]): r["team"] for r in v.track_teams(colours.repartition(5), by=("clip",)).collect()}
    assert len(got) == len(rows) and got == {(r["clip"], r["segment"], r["track_id"]): r["team"] for r in v.track_teams(colours.coalesce(1), by=("clip",)).collect()}
    assert {got[1, 0, i] for i in range(6)} == {"light"} and {got[1, 1, i] for i in range(6)} == {"dark"} and got[1, 1, 9] == "other"
    assert {i: got[2, 5, i] for i in range(8)} == {i: "dark" if i % 2 else "light" for i in range(8)}
    assert {got[3, 7, i] for i in range(3)} == {"other"} and [got[None, 8, i] for i in range(4)] == ["dark", "light"] * 2 and {got[4, 9, i] for i in range(5)} == {"light"}
    assert v.track_teams(colours.limit(0), by=("clip",)).collect() == []


def test_homographies_of_many_clips(spark):
    """Each clip's matrix equals the one of its landmarks alone, noise included; too few landmarks, landmarks in a line and one place give none."""
    rnd = random.Random(4)
    of = {c: [(rnd.uniform(0, 1280), rnd.uniform(0, 720)) for _ in range(n)] for c, n in ((1, 4), (2, 9), (3, 40))}
    to = lambda c, x, y: ((0.08 * x + 0.01 * y + c) / (1 + 2e-4 * y), (0.002 * x - 0.09 * y + 66) / (1 + 2e-4 * y))
    rows = [(c, x, y, *(q + rnd.uniform(-0.4, 0.4) for q in to(c, x, y))) for c, ps in of.items() for x, y in ps]
    rows += [(4, float(i * i), 1.0, 2.0, float(i)) for i in range(3)] + [(5, float(i), 2.0 * i, 3.0 * i, float(i)) for i in range(6)] + [(6, 1.0, 1.0, 1.0, 1.0)] * 5 + [(2, None, 1.0, 1.0, 1.0)]
    marks = spark.createDataFrame(rows, "clip int, ix double, iy double, px double, py double")
    maps = v.fit_homographies(marks)
    got = {r["clip"]: r["h"] for r in maps.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[4] is got[5] is got[6] is None
    errors = {c: sorted(r["error"] for r in v.landmark_errors(marks, maps).where(F.col("clip") == c).collect() if r["error"] is not None) for c in of}
    for c, ps in of.items():
        own = [r for r in rows if r[0] == c and r[1] is not None]
        h, far = v.fit_homography([r[1:3] for r in own], [r[3:5] for r in own])
        assert got[c] == pytest.approx(h, rel=1e-5, abs=1e-8) and errors[c] == pytest.approx(sorted(far), abs=1e-5)


def test_camera_chain(spark):
    pan = [1.0, 0.0, -7.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    steps = spark.createDataFrame([(1, f, pan) for f in range(100, 108)], "clip int, frame int, h array<double>")
    maps = camera.camera_maps(steps, 103, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0])
    point = maps.select("frame", g.apply_h(F.col("h"), F.lit(500.0) - 7 * (F.col("frame") - 103), F.lit(5.0))[0].alias("x")).collect()
    assert len(point) == 9 and {round(r["x"], 6) for r in point} == {500.0}


def test_tracking_csv(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text(",,,Home,,Home,,Home,\n,,,11,,1,,,\nPeriod,Frame,Time [s],Player11,,Player1,,Ball,\n1,1,0.04,0.10,0.50,0.60,0.25,0.50,0.50\n1,2,0.08,0.10,0.50,NaN,NaN,0.52,0.50\n2,3,0.12,0.90,0.50,0.40,0.75,NaN,NaN\n")
    rows = readers.read_tracking(spark, str(file))
    assert rows.count() == 7 and rows.where("player = 'Ball'").count() == 2
    x, y = g.tracking_to_metres(F.col("x"), F.col("y"))
    first = {r["player"]: (r["mx"], r["my"]) for r in rows.where("frame = 1").select("player", x.alias("mx"), y.alias("my")).collect()}
    assert first["Player11"][0] == pytest.approx(10.5) and first["Player1"][1] == pytest.approx(51.0)


def test_event_json_and_lineups(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"match_id": 1, "index": 1, "type": "Shot", "location": [110.0, 40.0], "shot_freeze_frame": [{"location": [1.0, 2.0], "teammate": false, "position": {"name": "Goalkeeper"}}]}]')
    row = readers.read_events(spark, str(tmp_path / "e.json")).first()
    assert row["location"] == [110.0, 40.0] and row["pass_cross"] is None and row["shot_freeze_frame"][0]["position"]["name"] == "Goalkeeper"
    lineups = spark.createDataFrame([(1, "A", "Ann Lee", "Annie"), (1, "B", "Bo", None), (1, "B", "Cy", "")], "match_id long, team string, player_name string, player_nickname string")
    assert readers.nicknames(lineups).first()["nicknames"] == {"Ann Lee": "Annie"}


def test_events_reach_the_operators(spark, tmp_path):
    """Shots in two matches' files: key passes by id within the match, places out of arrays, frames as points."""
    (tmp_path / "m").mkdir()
    for k, cross in ((1, "true"), (2, "false")):
        (tmp_path / "m" / f"{k}.json").write_text(
            '[{"match_id": %d, "index": 7, "id": "p", "type": "Pass", "team": "A", "period": 1, "minute": 3, "location": [80.0, 20.0], "pass_end_location": [100.0, 40.0], "pass_cross": %s},'
            '{"match_id": %d, "index": 8, "id": "s", "type": "Shot", "team": "A", "period": 1, "minute": 3, "location": [114.0, 32.0], "shot_key_pass_id": "p", "shot_outcome": "Goal", "shot_type": "Corner", "shot_body_part": "Right Foot",'
            ' "play_pattern": "From Corner", "shot_statsbomb_xg": 0.3, "shot_freeze_frame": [{"location": [119.0, 40.0], "teammate": false, "position": {"name": "Goalkeeper"}}]}]' % (k, cross, k)
        )
    events = loaders.operator_events(readers.read_events(spark, str(tmp_path / "m")))
    rows = {r["match_id"]: r for r in s.dataset(events).collect()}
    assert [rows[k]["follows_cross"] for k in (1, 2)] == [1, 0]
    assert (rows[1]["distance"], rows[1]["shot_type"], rows[1]["body_part"], rows[1]["play_pattern"], rows[1]["sb_xg"], rows[1]["ff_gk_distance"], rows[1]["is_goal"]) == (10.0, "Other", "Foot", "From Corner", 0.3, 1.0, 1)
    assert events.where("type = 'Pass' AND end_x = 100 AND end_y = 40").count() == 2


def test_settings_and_seasons(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"competitions": [{"competition_id": 1, "season_id": 5}, {"competition_id": 2, "season_id": 5}]}')
    seasons = loaders.configured_seasons(spark, loaders.read_settings(spark, str(tmp_path / "s.json")))
    matches = spark.createDataFrame([(10, 1, 5), (11, 1, 6), (12, 2, 5), (13, 3, 5)], "match_id long, competition_id long, season_id long")
    assert {r["match_id"] for r in loaders.configured_matches(matches, seasons).collect()} == {10, 12}
    readers.write_by_match(matches, str(tmp_path / "t"), ("competition_id", "season_id"))
    readers.write_by_match(spark.range(1000).selectExpr("id", "id % 2 AS match_id"), str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 1000
    season = loaders.read_season(spark, str(tmp_path / "t"), 1, 6)
    assert [r["match_id"] for r in season.collect()] == [11]
    plan = season._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(competition_id" in plan
    (tmp_path / "c.json").write_text('[{"competition_id": 1, "season_id": 5, "competition_name": "Cup", "season_name": "2001"}]')
    assert loaders.read_competitions(spark, str(tmp_path / "c.json")).first()["competition_name"] == "Cup"
    left = readers.with_match_keys(spark.createDataFrame([(10, "Pass")], "match_id long, type string"), matches).first()
    assert (left["competition_id"], left["season_id"]) == (1, 5)


def test_load_game(spark, tmp_path):
    """Three frames a half; the home side starts the second half on the right, so that half is turned."""
    head = ",,,Side,,Side,\n,,,1,,,\nPeriod,Frame,Time [s],Player1,,Ball,\n"
    times = [(1, 1, 0.04), (1, 2, 0.08), (1, 3, 0.12), (2, 4, 0.16), (2, 5, 0.20), (2, 6, 0.24)]
    for team, xs in (("home", [0.2, 0.2, 0.2, 0.8, 0.8, 0.8]), ("away", [0.7, 0.7, "NaN", 0.3, 0.3, 0.3])):
        (tmp_path / f"{team}.csv").write_text(head + "".join(f"{p},{f},{s},{x},{'NaN' if x == 'NaN' else 0.25},0.5,{0.5 if f < 6 else 0.25}\n" for (p, f, s), x in zip(times, xs)))
    names = "Team,Type,Subtype,Period,Start Frame,Start Time [s],End Frame,End Time [s],From,To,Start X,Start Y,End X,End Y\n"
    (tmp_path / "feed.csv").write_text(names + "Home,PASS,,1,1,0.04,2,0.08,Player1,Player2,0.2,0.25,0.4,0.5\nAway,SHOT,,2,5,0.2,6,0.24,Player3,,0.3,0.25,NaN,NaN\n")
    paths = [str(tmp_path / f"{n}.csv") for n in ("home", "away", "feed")]
    game = loaders.load_game(spark, *paths, clean=False)
    assert game.fps == 25.0 and values(game.turned, "period") == [(2,)]
    at = {(r["team"], r["frame"]): (r["x"], r["y"]) for r in game.tracking.collect()}
    assert len(at) == 12 and at["home", 1] == pytest.approx((21, 51)) and at["home", 5] == pytest.approx((21, 17)) and at["away", 3] == (None, None) and at["away", 4] == pytest.approx((73.5, 17))
    assert {r["frame"]: r["y"] for r in game.ball.collect()} == pytest.approx({1: 34, 2: 34, 3: 34, 4: 34, 5: 34, 6: 17})
    shot = game.events.where("type = 'SHOT'").first()
    assert (shot["start_x"], shot["start_y"], shot["end_x"], shot["team"]) == (pytest.approx(73.5), pytest.approx(17), None, "away")
    assert {r["team"]: (r["squad"], r["same_ball"]) for r in game.quality.collect()} == {"home": (1, True), "away": (1, True)}
    assert loaders.load_game(spark, *paths).tracking.where("flagged IS NOT NULL").count() == 12
    text_of_away = (tmp_path / "away.csv").read_text()
    (tmp_path / "away.csv").write_text(text_of_away.replace("2,6,0.24", "2,7,0.28"))
    with pytest.raises(ValueError):
        loaders.load_game(spark, *paths)


def test_load_games(spark, tmp_path):
    """Two games of different players in one pass, each equal to itself loaded alone; sides of different frames and different rates are errors."""
    rnd = random.Random(9)
    names = "Team,Type,Subtype,Period,Start Frame,Start Time [s],End Frame,End Time [s],From,To,Start X,Start Y,End X,End Y\n"
    alone = {}

    def write(game, squads, frames, step, shift=0):
        feed = tmp_path / "all" / "feed" / f"game={game}"
        feed.mkdir(parents=True, exist_ok=True)
        (feed / "feed.csv").write_text(names + "".join(f"Home,PASS,,{1 + f % 2},{f},{f * step},{f + 1},{(f + 1) * step},{squads['home'][0]},,{f / 50},0.25,NaN,NaN\n" for f in range(1, 6)))
        for team, squad in squads.items():
            folder = tmp_path / "all" / "tracking" / f"game={game}" / f"team={team}"
            folder.mkdir(parents=True, exist_ok=True)
            head = ",,,Side,,\n,,,1,,\nPeriod,Frame,Time [s]," + ",".join(f"{p}," for p in [*squad, "Ball"]) + "\n"
            off = shift if team == "away" else 0
            lines = [",".join(map(str, [1 if f < frames // 2 else 2, f + off, (f + off) * step, *(v for _ in squad for v in (("NaN", "NaN") if rnd.random() < 0.2 else (round(rnd.random(), 3), round(rnd.random(), 3)))), f / 100, 0.5])) for f in range(1, frames)]
            (folder / "track.csv").write_text(head + "\n".join(lines) + "\n")
            alone[game, team] = str(folder / "track.csv")
        alone[game, "feed"] = str(feed / "feed.csv")

    write(1, {"home": ["Player1", "Player2"], "away": ["Player3"]}, 21, 0.04)
    write(2, {"home": ["Player9"], "away": ["Player4", "Player5", "Player6"]}, 13, 0.04)
    everything = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    both = loaders.load_games(spark, str(tmp_path / "all"))
    assert both.fps == 25.0 and {(r["game"], r["team"]): r["squad"] for r in both.quality.collect()} == {(1, "home"): 2, (1, "away"): 1, (2, "home"): 1, (2, "away"): 3}
    for n in (1, 2):
        one = loaders.load_game(spark, alone[n, "home"], alone[n, "away"], alone[n, "feed"], n)
        for part in ("tracking", "ball", "events", "turned", "quality"):
            own, of_all = getattr(one, part), getattr(both, part).where(F.col("game") == n)
            assert everything(own.select(sorted(own.columns))) == everything(of_all.select(sorted(own.columns))) and set(own.columns) == set(of_all.columns)
    write(3, {"home": ["Player1"], "away": ["Player2"]}, 9, 0.04, shift=1)
    with pytest.raises(ValueError, match="games \\[3\\]"):
        loaders.load_games(spark, str(tmp_path / "all"))
    write(3, {"home": ["Player1"], "away": ["Player2"]}, 9, 0.1)
    with pytest.raises(ValueError, match="rate"):
        loaders.load_games(spark, str(tmp_path / "all"))


def test_arcs(spark):
    arcs = spark.createDataFrame(v.pitch_arcs(), "name string, cx double, cy double, r double, a0 double, a1 double")
    points = {(r["name"], r["k"]): (r["x"], r["y"]) for r in v.arc_samples(arcs, 5).collect()}
    assert points["arc_left", 0][0] == pytest.approx(16.5) and points["arc_left", 4][0] == pytest.approx(16.5) and points["arc_left", 2] == pytest.approx((20.15, 34)) and points["arc_right", 2] == pytest.approx((84.85, 34))
    assert points["circle", 2] == pytest.approx((52.5 + 9.15, 34))


def test_headline_and_suspicion(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.2, 0.3), (1, 0.9, 0.6, 0.7), (0, 0.2, 0.4, 0.1), (1, 0.4, 0.5, 0.8)], "y int, p double, q double, b double")
    row = m.headline(rows).first()
    assert row["auc"] == 1.0 and row["n"] == 4 and row["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.9) + math.log(0.8) + math.log(0.4)) / 4)
    told = {r["model"]: r["suspicious"] for r in m.suspicious(rows, "b", ("p", "q")).collect()}
    loss = lambda ps: -sum(math.log(p if y else 1 - p) for y, p in zip((0, 1, 0, 1), ps)) / 4
    assert told == {"p": loss([0.1, 0.9, 0.2, 0.4]) < loss([0.3, 0.7, 0.1, 0.8]), "q": False}
