"""Quantiles, ranks, folds, camera chains, hulls, lines and space control against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import camera, ml, quantiles, shape


@pytest.mark.parametrize("bins, limit", [(1024, 4096), (16, 5)])
def test_quantiles_equal_percentile(spark, monkeypatch, bins, limit):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    rng = random.Random(1)
    draw = lambda: rng.choice([None, rng.gauss(0, 1), float(rng.randint(0, 5)), 10 ** rng.uniform(-300, 300), -(10 ** rng.uniform(-9, 9)), float("nan"), 5e-324, 1e308, -1e308])
    rows = [(g, draw(), draw()) for g in ("a", "b", None) for _ in range(400)] + [("c", None, 1.0), ("d", 3.0, None)] + [("e", 7.0, 8.0)] * 40
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(3)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    known = df.where("v IS NOT NULL AND NOT isnan(v)")
    want = {r[0]: (r[1], r[2]) for r in known.groupBy("g").agg(F.count("v"), F.percentile("v", F.array(*[F.lit(p) for p in probs]))).collect()}
    assert {r["g"]: (r["n"], r["quantiles"]) for r in quantiles.quantiles(df, "v", probs, ("g",)).collect()} == want and "c" not in want
    both = quantiles.column_quantiles(df, ("v", "w"), (0.5,)).first()
    assert both["v"] == [known.agg(F.median("v")).first()[0]] and both["w"] == [df.where("NOT isnan(w)").agg(F.median("w")).first()[0]]
    assert quantiles.quantiles(df.limit(0), "v", probs, ("g",)).count() == 0


def test_ranks_of_groups_that_span_ranges(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 4 > 0, 1).alias("s"), F.col("id").alias("k"), (F.col("id") * 7919 % 500).alias("o")).repartition(3)
    got = quantiles.ranked(rows, ("s",), ("o",)).collect()
    for s in (1, None):
        assert [r["rank"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["o"])] == list(range(375 if s else 125))


def test_folds_are_dealt_as_one_by_one(spark):
    rng = random.Random(2)
    for k in (1, 2, 3, 5, 7):
        sizes = [rng.choice((1, 1, 1, 2, 3, 10, rng.randint(1, 300))) for _ in range(rng.randint(1, 200))]
        load_of, want = [0] * k, []
        for n, key in sorted(((n, i) for i, n in enumerate(sizes)), key=lambda s: (-s[0], s[1])):
            f = load_of.index(min(load_of))
            load_of[f] += n
            want.append((key, f))
        loads, got = [0] * k, []
        for n in sorted(set(sizes), reverse=True):
            keys = [i for i, s in enumerate(sizes) if s == n]
            parts, loads = ml.dealt_by_size(loads, n, len(keys))
            for rank, key in enumerate(keys):
                start, folds = [p for p in parts if p[0] <= rank][-1]
                got.append((key, folds[(rank - start) % len(folds)]))
        assert sorted(got) == sorted(want) and loads == load_of
    rows = spark.createDataFrame([(m,) for m, n in enumerate((9, 4, 4, 4, 2, 2, 1)) for _ in range(n)], "match_id int")
    assert dict(map(tuple, ml.grouped_folds(rows, 2).collect())) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}


def brute_chain(steps, reference, to_pitch):
    out = {}
    for clip in {c for c, *_ in steps}:
        step = {f: np.array(h).reshape(3, 3) for c, f, h in steps if c == clip}
        maps, at = {reference: np.array(to_pitch).reshape(3, 3)}, reference
        while at - 1 in step:
            maps[at - 1] = maps[at] @ step[at - 1]
            at -= 1
        at = reference
        while at in step:
            maps[at + 1] = maps[at] @ np.linalg.inv(step[at])
            at += 1
        out |= {(clip, f): (m / m[2, 2]).ravel() for f, m in maps.items()}
    return out


@pytest.mark.parametrize("block", [2, 5, 64])
def test_camera_chains(spark, monkeypatch, block):
    monkeypatch.setattr(camera, "BLOCK", block)
    noise = np.random.default_rng(3)
    steps = [(c, f, (np.eye(3) + 0.05 * noise.normal(size=(3, 3))).ravel().tolist()) for c in (1, 2, 3, 4) for f in range(20) if (c, f) not in ((2, 4), (2, 15), (3, 9), (4, 8))]
    to_pitch = [1.0, 0.1, 0, 0.2, 1.0, 0.3, 0.01, 0.02, 1.0]
    df = spark.createDataFrame([*steps, (5, 40, steps[0][2]), (5, 9, None)], "clip int, frame int, h array<double>").repartition(3)
    got = {(r["clip"], r["frame"]): r["h"] for r in camera.camera_maps(df, 9, to_pitch).collect()}
    want = brute_chain([*steps, (5, 40, steps[0][2])], 9, to_pitch)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    assert camera.camera_maps(df.limit(0), 9, to_pitch).count() == 0


def test_long_chains_stay_finite(spark):
    zoom = [2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0]
    steps = spark.range(3000).select(F.lit(1).alias("clip"), F.col("id").cast("int").alias("frame"), F.array(*[F.lit(v) for v in zoom]).alias("h"))
    maps = camera.camera_maps(steps, 1500, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0])
    assert maps.count() == 3001 and maps.where("frame = 1490").first()["h"][0] == pytest.approx(1024)


def brute_hull(points):
    pts = sorted(set(points))
    area = 0.0
    for a in pts:
        for b in pts:
            side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in pts]
            inside = [(c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) <= 0 for c in pts]
            if a != b and all(s > 0 or (s == 0 and i) for s, i in zip(side, inside)):
                area += (a[0] * b[1] - b[0] * a[1]) / 2
    return area if len(pts) > 2 and area > 0 else None


def test_hulls(spark):
    rng = random.Random(4)
    sets = [[], [(1, 1)], [(0, 0), (1, 1)], [(3, 0), (3, 5), (3, 9)], [(0, 0), (2, 2), (5, 5)], [(2, 1), (8, 1), (2, 9), (3, 2)], [(0, 0)] * 4]
    sets += [[(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(3, 14))] for _ in range(150)]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in s]) for i, s in enumerate(sets)] + [(len(sets), None)], "i int, p array<struct<x:double,y:double>>")
    got = {r["i"]: r["area"] for r in df.select("i", shape.hull_area(F.col("p")).alias("area")).collect()}
    assert all(got[i] == pytest.approx(brute_hull(s)) if brute_hull(s) else got[i] is None for i, s in enumerate(sets)) and got[len(sets)] is None


def brute_lines(xs, ks):
    v = sorted(xs)
    spread = lambda part: sum((x - sum(part) / len(part)) ** 2 for x in part)
    best = None
    for k in ks:
        splits = [[v[a:b] for a, b in zip((0, *c), (*c, len(v)))] for c in combinations(range(1, len(v)), k - 1)]
        parts = min(splits, key=lambda p: round(sum(map(spread, p)), 9))
        total = 0.0
        for j, part in enumerate(parts):
            for x in part if len(part) > 1 else ():
                inside = sum(abs(x - o) for o in part) / (len(part) - 1)
                nearest = min(sum(abs(x - o) for o in other) / len(other) for i, other in enumerate(parts) if i != j)
                total += (nearest - inside) / max(nearest, inside) if max(nearest, inside) > 0 else 0.0
        if best is None or round(total / len(v), 9) > round(best[0], 9):
            best = (total / len(v), k, "-".join(str(len(p)) for p in parts))
    return best


def test_lines(spark):
    rng = random.Random(5)
    sets = [[11, 13, 14, 30, 31, 33, 36, 55, 57, 58], [5.0] * 5 + [50.0] * 5, [float(i * i) for i in range(10)]] + [[round(rng.uniform(0, 100), 2) for _ in range(10)] for _ in range(60)]
    rows = [(1, "home", 1, w, "s", 75, f"P{i}", float(x), 0.0) for w, s in enumerate(sets) for i, x in enumerate(s)] + [(1, "home", 1, 999, "s", 75, "P0", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "game int, team string, period int, window int, state string, frames int, player string, x double, y double")
    got = shape.formations(df).collect()
    for w, s in enumerate(sets):
        own = [r for r in got if r["window"] == w]
        score, k, formation = brute_lines(s, (2, 3, 4))
        assert len(own) == 10 and all(r["silhouette"] == pytest.approx(score, abs=2e-9) and (r["k"], r["formation"]) == (k, formation) for r in own)
        assert [r["line"] for r in sorted(own, key=lambda r: r["x"])] == [j for j, n in enumerate(formation.split("-")) for _ in range(int(n))]
    assert not [r for r in got if r["window"] == 999]


def test_control_equals_all_cells_against_all_players(spark):
    rng = random.Random(6)
    frames = [[(rng.choice(("home", "away")), f"P{k}", rng.choice((rng.uniform(-2, 22), float(rng.randint(0, 20)))), rng.choice((rng.uniform(-2, 12), float(rng.randint(0, 10))))) for k in range(rng.randint(1, 12))] for _ in range(25)]
    frames += [[("home", "a", 5.0, 5.0), ("away", "b", 5.0, 5.0)], [("home", "a", 5.0, 2.0), ("away", "b", 5.0, 8.0), ("away", "c", 15.0, 5.0)]]
    rows = [(1, f, *p) for f, ps in enumerate(frames) for p in ps] + [(1, 0, "home", "lost", None, None), (1, 900, "home", "lost", None, None)]
    df = spark.createDataFrame(rows, "game int, frame int, team string, player string, x double, y double")
    runs = shape.control(df, ("game", "frame"), 0.5, 20.0, 10.0)
    got = {(r["frame"], r["ix"], r["iy"]): (r["team"], r["player"]) for r in shape.control_cells(runs).collect()}
    assert len(got) == len(frames) * 40 * 20
    for f, ps in enumerate(frames):
        for ix in range(40):
            for iy in range(20):
                d = {(t, p): (x - (ix + 0.5) / 2) ** 2 + (y - (iy + 0.5) / 2) ** 2 for t, p, x, y in ps}
                assert d[got[f, ix, iy]] <= min(d.values()) + 1e-9
    assert {v for (f, *_), v in got.items() if f == 25} == {("away", "b")}  # a tie everywhere goes to the first by name
    share = {r["frame"]: r["home_share"] for r in shape.control_share(runs, ("game", "frame")).collect()}
    assert share[25] == 0 and all(share[f] == pytest.approx(sum(v[0] == "home" for (g, *_), v in got.items() if g == f) / 800) for f in range(len(frames)))


def test_scores_and_edges_equal_c_to_the_last_bit(spark):
    """Mirrored places have scores that differ in the last bit or not at all; ranks and quantile edges hang on it."""
    import math

    from terrace.functions import libm
    from terrace.operators import metrics, shots

    grid = spark.sql("SELECT k, j, 60 + k * 0.6D AS x, j / 10D AS y FROM (SELECT id AS k FROM range(0, 100, 9)), (SELECT id AS j FROM range(801))")
    for r in grid.withColumn("p", shots.closed_form_xg(F.col("x"), F.col("y"))).withColumn("loss", metrics.row_loss(F.lit(1), F.col("p"), libm.log)).collect():
        dx, low, high = 120 - r["x"], 36 - r["y"], 44 - r["y"]
        angle = math.atan2(abs(dx * high - low * dx), dx * dx + low * high)
        p = 1 / (1 + math.exp(0.12 * math.sqrt(dx * dx + (40 - r["y"]) * (40 - r["y"])) - 1.5 * angle + 0.5))
        assert (r["p"], r["loss"]) == (p, -math.log(p))
    a = 0.3
    b = math.nextafter(a, 1)
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    values = sorted(rng.random() for _ in range(27))
    for given in ([a] * 8 + [b] * 8, values):  # the median of the first lies between neighbours
        wanted = duckdb.execute("SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [given]).fetchone()[0]
        rows = spark.createDataFrame([(0, v) for v in given], "y int, p double")
        assert sorted(metrics._edges(rows, 10).first()["edges"]) == sorted(wanted)
    nulls = spark.createDataFrame([(None,), (0.0,), (1e6,)], "v double")
    assert [tuple(r) for r in nulls.select(libm.exp(F.col("v")), libm.log(F.col("v"))).collect()] == [(None, None), (1.0, -math.inf), (math.inf, math.log(1e6))]


def test_shares_of_frames_equal_those_of_runs(spark):
    rng = random.Random(8)
    rows = [(g, f, rng.choice(("home", "away")), f"P{k}", float(rng.randint(0, 105)), rng.uniform(0, 68)) for g in (1, 2) for f in range(70) for k in range(rng.randint(1, 22))]
    df = spark.createDataFrame(rows, "game int, frame int, team string, player string, x double, y double").repartition(3)
    by = ("game", "frame")
    want = {(r["game"], r["frame"]): r["home_share"] for r in shape.control_share(shape.control(df, by), by).collect()}
    assert {(r["game"], r["frame"]): r["home_share"] for r in shape.control_of_frames(df, by).collect()} == want and len(want) == 140
    assert shape.control_of_frames(df.limit(0), by).count() == 0


def test_a_step_of_a_camera_chain_makes_its_product_once(spark):
    """Mentions of an expression add up: interpreted, a step's product used to be made some twenty times."""
    rows = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (2, 0, 0, 0, 4, 0, 0, 0, -8)]).alias("probe"))
    out = rows.select(camera.scaled(F.concat("probe")).alias("m"))
    assert out._jdf.queryExecution().analyzed().expressions().toString().count("probe#") == 1
    assert out.first()["m"] == [0.25, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, -1.0]
    assert rows.select(camera.scaled(F.transform("probe", lambda v: v * 0)).alias("m")).first()["m"] == [None] * 9


def test_logistic_selection_learns_side_by_side(spark):
    """Few jobs, whatever the grid, and the losses of the classifier's own fits."""
    from terrace.operators import metrics

    rng = random.Random(5)
    rows = []
    for k in range(600):
        d, head = rng.uniform(2, 40), rng.random() < 0.2
        goal = rng.random() < 1 / (1 + np.exp(0.12 * d - 0.8 + head))
        rows.append((k % 9, k, d, rng.uniform(0.1, 2), k % 2, 0, 0, k % 3 % 2, k % 90, k % 4 - 1, "Head" if head else "Foot", "Open Play", "Regular Play" if k % 5 else "From Corner", int(goal)))
    shots = spark.createDataFrame(rows, "match_id int, idx int, distance double, angle double, first_time int, follows_through_ball int, follows_cross int, under_pressure int, minute int, score_diff int, body_part string, shot_type string, play_pattern string, is_goal int")
    shots = shots.join(ml.grouped_folds(shots, 2), "match_id").persist()
    grid = [{"strength": c} for c in (0.001, 0.01, 1.0)]
    parts = [(ml.Prepared(shots.where(F.col("fold") != f), "logreg_all"), shots.where(F.col("fold") == f)) for f in range(2)]
    spark.sparkContext.setJobGroup("side-by-side", "")
    found = ml._logistic_losses([(p, p.vectors(held)) for p, held in parts], grid)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("side-by-side"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for (prepared, held), losses in zip(parts, found):
        for k, params in enumerate(grid):
            want = metrics.score_all(prepared.fitted(params).transform(held).withColumn("y", F.col("is_goal"))).first()["log_loss"]
            assert losses[k] == pytest.approx(want, abs=1e-5)
    assert jobs <= 40  # the optimizer's own rounds took more than a hundred
    none = shots.where("false")
    assert ml._logistic_losses([(p, p.vectors(none)) for p, _ in parts], grid) == []
    one_class = ml.Prepared(shots.where("is_goal = 0"), "logreg_all")
    assert list(ml._logistic_losses([(one_class, one_class.vectors(shots.where("is_goal = 0")))], grid)[0].values()) == pytest.approx([0.0] * 3, abs=1e-12)
