"""Video analysis on tables: cut signals, detections, cameras as matrices, positions on the pitch."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..sources.scratch import written
from .quantiles import quantiles

PERSON, BALL = 0, 32
HIST_DIST, SPIKE_LEAST, SPIKE_RATIO = 0.35, 10.0, 3.5
LEAST_FRAMES = 25
COLOUR, ROUNDS = ("L", "a", "b"), 100
#: Weights of a quadratic fitted to SG rows: slope, and half the curvature.
SG = 11


def _median(values: Column) -> Column:
    v, n = F.array_sort(values), F.size(values)
    low, high = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def cuts(signal: DataFrame) -> DataFrame:
    """(clip, frame): where a new shot starts. signal has clip, frame, hist_dist and diff, the change from the frame before.

    Either the colours differ by more than HIST_DIST, or the pixels' change is SPIKE_LEAST and SPIKE_RATIO times the median of the six
    changes before and after; a clip's first frame has no change and is no neighbour.
    """
    w = Window.partitionBy("clip").orderBy("frame")
    known = F.when(F.row_number().over(w) > 1, F.col("diff"))
    rows = signal.withColumn("known", known)
    around = rows.withColumn("near", F.concat(F.collect_list("known").over(w.rowsBetween(-6, -1)), F.collect_list("known").over(w.rowsBetween(1, 6))))
    spike = F.col("known").isNotNull() & (F.size("near") > 0) & (F.col("diff") > SPIKE_LEAST) & (F.col("diff") > SPIKE_RATIO * F.greatest(_median(F.col("near")), F.lit(1.0)))
    return around.where(F.coalesce(F.col("hist_dist") > HIST_DIST, F.lit(False)) | F.coalesce(spike, F.lit(False))).select("clip", "frame")


def segments(found: DataFrame, clips: DataFrame, least: int = LEAST_FRAMES) -> DataFrame:
    """(clip, start, end) between cuts, the end exclusive; clips has clip, n_frames."""
    starts = found.select("clip", F.col("frame").alias("start")).unionByName(clips.select("clip", F.lit(0).cast("int").alias("start"))).distinct().join(clips, "clip")
    end = F.coalesce(F.lead("start").over(Window.partitionBy("clip").orderBy("start")), F.col("n_frames"))
    return starts.select("clip", F.col("start").cast("int").alias("start"), end.cast("int").alias("end")).where(F.col("end") - F.col("start") >= least)


def frames_of(found: DataFrame) -> DataFrame:
    """(clip, frame, start): each frame of each segment; an equi-join on it replaces an interval join."""
    return found.select("clip", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("frame"))


def containing(found: DataFrame, frame: int) -> DataFrame:
    return found.where((F.col("start") <= frame) & (F.col("end") > frame))


def wide_shots(det: DataFrame, frame_height: float, least: int = 5, most: float = 0.28) -> DataFrame:
    """(segment, frame, wide): five or more people on grass who are small on the median."""
    people = det.where((F.col("cls") == PERSON) & F.col("on_grass"))
    height = F.percentile((F.col("y2") - F.col("y1")) / frame_height, 0.5)
    return people.groupBy("segment", "frame").agg(F.count(F.lit(1)).alias("people"), height.alias("height")).select("segment", "frame", ((F.col("people") >= least) & (F.col("height") < most)).alias("wide"))


def segment_quality(det: DataFrame, ends: DataFrame) -> DataFrame:
    """Per segment: players a frame over all frames from the first with a player to the end, ids, track length, and shares. ends has segment, last (frame)."""
    people = det.where((F.col("cls") == PERSON) & F.col("on_grass") & (F.col("track_id") >= 0))
    spine = people.groupBy("segment").agg(F.min("frame").alias("first")).join(ends, "segment").select("segment", F.explode(F.sequence("first", "last")).alias("frame"))
    counts = spine.join(people.groupBy("segment", "frame").agg(F.count_distinct("track_id").alias("n")), ["segment", "frame"], "left").na.fill(0, ["n"])
    by_frame = counts.groupBy("segment").agg(F.avg("n").alias("players_per_frame"), F.percentile("n", 0.5).alias("median_players"), F.count(F.lit(1)).alias("frames"))
    tracks = people.groupBy("segment", "track_id").agg(F.count_distinct("frame").alias("length")).groupBy("segment").agg(F.count(F.lit(1)).alias("ids"), F.avg("length").alias("mean_track_length"))
    rest = det.groupBy("segment").agg(F.count_distinct(F.when(F.col("cls") == BALL, F.col("frame"))).alias("ball_frames"), F.count_if((F.col("cls") == PERSON) & ~F.col("on_grass")).alias("removed"))
    joined = by_frame.join(tracks, "segment").join(rest, "segment")
    return joined.withColumns({"ids_per_player": F.col("ids") / F.nullif(F.col("median_players"), F.lit(0.0)), "ball_share": F.col("ball_frames") / F.col("frames")}).drop("ball_frames")


def track_colours(det: DataFrame, least: int = 5) -> DataFrame:
    """Median colour of each track on grass with ``least`` boxes."""
    people = det.where((F.col("cls") == PERSON) & F.col("on_grass") & F.col("L").isNotNull() & (F.col("track_id") >= 0))
    return people.groupBy("segment", "track_id").agg(F.percentile("L", 0.5).alias("L"), F.percentile("a", 0.5).alias("a"), F.percentile("b", 0.5).alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _two_centres(points: DataFrame) -> DataFrame:
    """(g, c0, c1): two centres of each group's points (g, p), p a struct of L, a and b, by Lloyd's rounds for all groups at once.

    Each group starts three times, from the least and the greatest point by each colour axis; the start with the least inertia wins, the
    first of equal ones. A round moves one row a start, cluster and task, never a group's points. Centres are rounded to nine places, so that the
    order of sums doesn't matter; a centre without points stays where it is.
    """
    ends = [(f([F.col("p")[axis], F.col("p")]), axis) for axis in COLOUR for f in (lambda c: F.min(F.struct(*c)), lambda c: F.max(F.struct(*c)))]
    found = points.groupBy("g").agg(*[e.getField("p").alias(f"{axis}{i % 2}") for i, (e, axis) in enumerate(ends)])
    starts = F.array(*[F.struct(F.lit(i).alias("start"), F.col(f"{axis}0").alias("c0"), F.col(f"{axis}1").alias("c1")) for i, axis in enumerate(COLOUR)])
    state = written(found.select("g", F.explode(starts).alias("s")).select("g", "s.*", F.lit(True).alias("moved")), "kit-centres")
    for _ in range(ROUNDS):
        second = _apart("c1") < _apart("c0")
        means = [F.struct(*[F.coalesce(F.round(F.avg(F.when(second == bool(i), F.col("p")[axis])), 9), F.col(f"c{i}")[axis]).alias(axis) for axis in COLOUR]).alias(f"n{i}") for i in (0, 1)]
        moved = points.join(state.drop("moved"), "g").groupBy("g", "start", "c0", "c1").agg(*means)
        state = written(moved.select("g", "start", F.col("n0").alias("c0"), F.col("n1").alias("c1"), ((F.col("n0") != F.col("c0")) | (F.col("n1") != F.col("c1"))).alias("moved")), "kit-centres")
        if state.where("moved").isEmpty():
            break
    inertia = points.join(state, "g").groupBy("g", "start", "c0", "c1").agg(F.round(F.sum(F.least(_apart("c0"), _apart("c1"))), 6).alias("inertia"))
    return inertia.groupBy("g").agg(F.min_by(F.struct("c0", "c1"), F.struct("inertia", "start")).alias("c")).select("g", "c.c0", "c.c1")


def _apart(centre: str) -> Column:
    """Squared distance of the colour p from a centre."""
    return reduce(lambda a, b: a + b, [(F.col("p")[axis] - F.col(centre)[axis]) * (F.col("p")[axis] - F.col(centre)[axis]) for axis in COLOUR])


def track_teams(colours: DataFrame, factor: float = 2.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, segment, track_id, team): light or dark by two clusters of each clip's track colours, other for tracks further from both than ``factor`` medians.

    ``by`` names a clip; without it all tracks are of one. All tracks of a clip with fewer than four are other; null is a clip of its own.
    """
    rows = colours.select(F.struct(*by, F.lit(0).alias("of_all")).alias("g"), *by, "segment", "track_id", F.struct(*[F.col(axis).cast("double").alias(axis) for axis in COLOUR]).alias("p"))
    rows = written(rows, "kit-colours")
    centres = _two_centres(rows.select("g", "p")).join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    near = rows.join(centres, "g").withColumn("distance", F.round(F.sqrt(F.least(_apart("c0"), _apart("c1"))), 9))
    near = written(near, "kit-distances")
    middle = quantiles(near, "distance", (0.5,), ("g",)).select("g", F.get("quantiles", F.lit(0)).alias("median"))
    first = _apart("c0") <= _apart("c1")
    light = F.when(F.col("c0")["L"] >= F.col("c1")["L"], first).otherwise(~first)
    team = F.when((F.col("n") < 4) | (F.col("distance") > factor * F.col("median")), "other").when(light, "light").otherwise("dark")
    return near.join(middle, "g").select(*by, "segment", "track_id", team.alias("team"))


def with_teams(det: DataFrame, teams: DataFrame) -> DataFrame:
    """Detections with a team: the track's, else ball or other."""
    default = F.when(F.col("cls") == BALL, "ball").otherwise("other")
    return det.join(teams, ["segment", "track_id"], "left").withColumn("team", F.coalesce("team", default))


def fit_homography(image: list[tuple[float, float]], pitch: list[tuple[float, float]]) -> tuple[list[float], list[float]]:
    """Least-squares 3 x 3 matrix from four or more point pairs, and each pair's distance on the pitch. A handful of landmarks, so on the driver."""
    if len(image) < 4:
        raise ValueError("a homography needs four point pairs or more")

    def normaliser(p: np.ndarray) -> np.ndarray:
        centre = p.mean(axis=0)
        scale = np.sqrt(2) / np.linalg.norm(p - centre, axis=1).mean()
        return np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])

    a, b = np.array(image, float), np.array(pitch, float)
    ta, tb = normaliser(a), normaliser(b)
    one = np.ones((len(a), 1))
    pa, pb = np.hstack([a, one]) @ ta.T, np.hstack([b, one]) @ tb.T
    rows = []
    for (x, y, _), (u, v, _) in zip(pa, pb):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    h = h / h[2, 2]
    mapped = np.hstack([a, one]) @ h.T
    return h.ravel().tolist(), np.linalg.norm(mapped[:, :2] / mapped[:, 2:] - b, axis=1).tolist()


def fit_homographies(marks: DataFrame, by: tuple[str, ...] = ("clip",)) -> DataFrame:
    """(by, h, n): the least-squares matrix of each clip from its landmarks (by, ix, iy in the image; px, py on the pitch), all clips at once.

    Points are moved and scaled to their mean and mean distance, and each clip's normal equations are a sum of 9 x 9 products,
    combined before they are shuffled, so that a clip may have any number of landmarks; Python solves one such matrix a clip. Landmarks with a null
    are passed over. h is null for clips with fewer than four landmarks or without a spread, and where the landmarks leave more than one matrix.
    """
    known = marks.where(F.col("ix").isNotNull() & F.col("iy").isNotNull() & F.col("px").isNotNull() & F.col("py").isNotNull())
    rows = known.select(F.struct(*by, F.lit(0).alias("of_all")).alias("g"), *[F.col(c).cast("double").alias(c) for c in ("ix", "iy", "px", "py")])
    means = rows.groupBy("g").agg(*[F.avg(c).alias(f"m_{c}") for c in ("ix", "iy", "px", "py")], F.count(F.lit(1)).alias("n"))
    moved = rows.join(means, "g")
    off = lambda c: F.col(c) - F.col(f"m_{c}")
    spread = moved.groupBy("g", "n", *[f"m_{c}" for c in ("ix", "iy", "px", "py")]).agg(F.avg(F.hypot(off("ix"), off("iy"))).alias("d_i"), F.avg(F.hypot(off("px"), off("py"))).alias("d_p"))
    fit = rows.join(spread, "g")
    scale = lambda d: np.sqrt(2) / F.nullif(F.col(d), F.lit(0.0))
    unit = fit.select("g", "n", "m_ix", "m_iy", "m_px", "m_py", "d_i", "d_p", *[(off(c) * scale(f"d_{c[0]}")).alias(c) for c in ("ix", "iy", "px", "py")])
    x, y, u, v, one, zero = F.col("ix"), F.col("iy"), F.col("px"), F.col("py"), F.lit(1.0), F.lit(0.0)
    pair = ([x, y, one, zero, zero, zero, -u * x, -u * y, -u], [zero, zero, zero, x, y, one, -v * x, -v * y, -v])
    sums = [F.sum(pair[0][i] * pair[0][j] + pair[1][i] * pair[1][j]) for i in range(9) for j in range(i, 9)]
    whole = unit.groupBy("g", "n", "m_ix", "m_iy", "m_px", "m_py", "d_i", "d_p").agg(F.array(*sums).alias("normal"))
    return whole.select(*[F.col(f"g.{c}").alias(c) for c in by], _solved("normal", F.array("m_ix", "m_iy", "d_i"), F.array("m_px", "m_py", "d_p")).alias("h"), "n")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solved(normal: pd.Series, image: pd.Series, pitch: pd.Series) -> pd.Series:
    """The direction that each 9 x 9 matrix (its upper half) shortens most, as a matrix between the points as they came."""
    at = np.triu_indices(9)

    def scaling(m: np.ndarray) -> np.ndarray:
        s = np.sqrt(2) / m[2]
        return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

    def one(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[float] | None:
        n, a, b = (np.asarray(v, float) for v in (n, a, b))  # a null sum is not a number
        if not np.isfinite(n).all() or a[2] == 0 or b[2] == 0:
            return None
        full = np.zeros((9, 9))
        full[at] = n
        sizes, ways = np.linalg.eigh(full + np.triu(full, 1).T)
        if sizes[1] <= 1e-12 * sizes[-1]:
            return None
        h = np.linalg.inv(scaling(b)) @ ways[:, 0].reshape(3, 3) @ scaling(a)
        return (h / (h[2, 2] or np.abs(h).max())).ravel().tolist()

    return pd.Series([one(*of) for of in zip(normal, image, pitch)], dtype=object)


def landmark_errors(marks: DataFrame, maps: DataFrame, by: tuple[str, ...] = ("clip",)) -> DataFrame:
    """Landmarks with ``error``: the distance on the pitch between each and its image under the clip's matrix; null without one."""
    x, y = g.apply_h(F.col("h"), F.col("ix"), F.col("iy"))
    return marks.join(maps.select(*by, "h"), list(by), "left").withColumn("error", F.hypot(x - F.col("px"), y - F.col("py"))).drop("h")


def players_to_pitch(det: DataFrame, maps: DataFrame) -> DataFrame:
    """Detections with X, Y on the pitch; frames without a matrix drop out."""
    fx, fy = g.feet(F.col("cls"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), BALL)
    joined = det.join(maps, "frame").withColumns({"__fx": fx, "__fy": fy})
    x, y = g.apply_h(F.col("h"), F.col("__fx"), F.col("__fy"))
    return joined.withColumns({"X": x, "Y": y}).drop("h", "__fx", "__fy")


def valid_window(scores: DataFrame, reference: int, least: float = 3.0) -> DataFrame:
    """(clip, start, end): the run of frames around the reference whose score, a centred median of five, is good; the reference is always in."""
    w = Window.partitionBy("clip").orderBy("frame")
    smooth = F.percentile("score", 0.5).over(w.rowsBetween(-2, 2))
    good = scores.withColumn("good", F.coalesce(smooth >= least, F.lit(False)) | (F.col("frame") == reference))
    marked = good.withColumn("island", F.sum(F.when(F.col("good") & ~F.lag("good", 1, False).over(w), 1).otherwise(0)).over(w)).where("good")
    ranges = marked.groupBy("clip", "island").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    return ranges.where((F.col("start") <= reference) & (F.col("end") >= reference)).select("clip", "start", "end")


def usable_tracks(pos: DataFrame, least: int = 50, max_gap: int = 2) -> DataFrame:
    """First row of each frame of the tracks of people with ``least`` frames and no longer gap."""
    rows = pos.where((F.col("cls") == PERSON) & (F.col("track_id") >= 0))
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("track_id", "frame").orderBy("det_id"))).where("__n = 1").drop("__n")
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy("track_id").orderBy("frame"))
    stats = first.withColumn("__gap", gap).groupBy("track_id").agg(F.count(F.lit(1)).alias("__rows"), F.max("__gap").alias("__most"))
    fit = stats.where((F.col("__rows") >= least) & (F.coalesce("__most", F.lit(0)) <= max_gap + 1)).select("track_id")
    return first.join(fit, "track_id", "left_semi")


def track_motion(pos: DataFrame, fps: float, least: int = 50, max_gap: int = 2, most: float = 12.0) -> DataFrame:
    """Distance and speeds of each usable track, off a quadratic fitted to SG frames; gaps are bridged by straight lines.

    At a track's ends the first or last fit is read at the frame's place in it.
    """
    first = usable_tracks(pos, least, max_gap)
    w = Window.partitionBy("track_id").orderBy("frame")
    nxt = first.withColumns({c: F.lead(f).over(w) for c, f in (("__nf", "frame"), ("__nx", "X"), ("__ny", "Y"))})
    dense = nxt.withColumn("f", F.explode(F.sequence("frame", F.coalesce(F.col("__nf") - 1, F.col("frame")))))
    share = F.when(F.col("f") == F.col("frame"), F.lit(0.0)).otherwise((F.col("f") - F.col("frame")) / (F.col("__nf") - F.col("frame")))
    line = dense.select("track_id", "team", "f", *[(F.col(c) + F.when(share == 0, F.lit(0.0)).otherwise((F.col(n) - F.col(c)) * share)).alias(c.lower()) for c, n in (("X", "__nx"), ("Y", "__ny"))])
    h = SG // 2
    s2 = sum(i * i for i in range(-h, h + 1))
    curve = sum((i * i - s2 / SG) ** 2 for i in range(-h, h + 1))
    by = Window.partitionBy("track_id").orderBy("f")
    around = {c: [F.lag(c, -i).over(by) if i < 0 else F.lead(c, i).over(by) if i else F.col(c) for i in range(-h, h + 1)] for c in ("x", "y")}
    fitted = line.withColumns(
        {f"{k}_{c}": reduce(lambda a, b: a + b, [wt(i) * v for i, v in zip(range(-h, h + 1), around[c])]) for c in ("x", "y") for k, wt in (("a1", lambda i: i / s2), ("a2", lambda i: (i * i - s2 / SG) / curve))}
    ).withColumns({"__i": F.row_number().over(by), "__n": F.count(F.lit(1)).over(Window.partitionBy("track_id"))})
    middle = F.least(F.greatest(F.col("__i"), F.lit(h + 1)), F.col("__n") - h)
    whole = Window.partitionBy("track_id").orderBy("f").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"{k}_{c}_{e}": (F.first if e == "lo" else F.last)(f"{k}_{c}", ignorenulls=True).over(whole) for k in ("a1", "a2") for c in ("x", "y") for e in ("lo", "hi")}
    off = F.col("__i") - middle
    pick = lambda n: F.when(off < 0, F.col(f"{n}_lo")).when(off > 0, F.col(f"{n}_hi")).otherwise(F.col(n))
    v = {c: (pick(f"a1_{c}") + 2 * off * pick(f"a2_{c}")) * fps for c in ("x", "y")}
    speeds = fitted.withColumns(ends).withColumn("speed", F.hypot(v["x"], v["y"]))
    named = first.groupBy("track_id", "team").agg(F.count(F.lit(1)).alias("n")).groupBy("track_id").agg(F.min_by("team", F.struct(-F.col("n"), "team")).alias("team"))
    out = speeds.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("speed") / fps).alias("distance_m"), F.avg("speed").alias("mean_speed_ms"), F.max("speed").alias("max_speed_ms"))
    return out.join(named, "track_id").withColumns({"seconds": F.round(F.col("frames") / fps, 1), "implausible_speed": F.col("max_speed_ms") > most})


def trails(pos: DataFrame, last: int = 30) -> DataFrame:
    """Each row with the track's last places, itself included."""
    w = Window.partitionBy("segment", "track_id").orderBy("frame", "det_id").rowsBetween(-(last - 1), 0)
    return pos.where("track_id >= 0").withColumn("trail", F.collect_list(F.struct("X", "Y")).over(w))


def radar(pos: DataFrame, scale: float = 8.0, margin: float = 5.0, length: float = g.LENGTH, width: float = g.WIDTH) -> DataFrame:
    """Pixels of the places that are on the pitch or within a margin of it."""
    inside = F.col("X").between(-margin, length + margin) & F.col("Y").between(-margin, width + margin)
    return pos.where(inside).withColumns({"px": F.round((F.col("X") + margin) * scale).cast("int"), "py": F.round((width - F.col("Y") + margin) * scale).cast("int")})


def pitch_lines(length: float = g.LENGTH, width: float = g.WIDTH) -> list[tuple[str, float, float, float, float]]:
    """The straight lines of one pitch by the laws of the game: name and both ends, in metres."""
    box, small, mid = 40.32 / 2, 18.32 / 2, width / 2
    lines = [("touch_low", 0.0, 0.0, length, 0.0), ("touch_high", 0.0, width, length, width), ("halfway", length / 2, 0.0, length / 2, width)]
    for side, x, into in (("left", 0.0, 1.0), ("right", length, -1.0)):
        lines.append((f"goal_{side}", x, 0.0, x, width))
        for name, half, depth in (("box", box, 16.5), ("small", small, 5.5)):
            lines += [(f"{name}_{side}_front", x + into * depth, mid - half, x + into * depth, mid + half), (f"{name}_{side}_low", x, mid - half, x + into * depth, mid - half), (f"{name}_{side}_high", x, mid + half, x + into * depth, mid + half)]
    return lines


def pitch_arcs(length: float = g.LENGTH, width: float = g.WIDTH) -> list[tuple[str, float, float, float, float, float]]:
    """The round markings of one pitch by the laws of the game: name, centre, radius, and the angles at both ends."""
    mid, turn, radius = width / 2, float(np.arccos((16.5 - 11.0) / 9.15)), 9.15
    return [("circle", length / 2, mid, radius, -np.pi, np.pi), ("arc_left", 11.0, mid, radius, -turn, turn), ("arc_right", length - 11.0, mid, radius, np.pi - turn, np.pi + turn)]


def arc_samples(arcs: DataFrame, n: int) -> DataFrame:
    """n points on each arc (name, cx, cy, r, a0, a1), ends included."""
    angle = F.col("a0") + (F.col("a1") - F.col("a0")) * F.col("k") / (n - 1)
    return arcs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("name", "k", (F.col("cx") + F.col("r") * F.cos(angle)).alias("x"), (F.col("cy") + F.col("r") * F.sin(angle)).alias("y"))


def line_samples(lines: DataFrame, n: int) -> DataFrame:
    """n points on each line (name, x0, y0, x1, y1), ends included."""
    share = F.col("k") / (n - 1)
    return lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("name", "k", (F.col("x0") + (F.col("x1") - F.col("x0")) * share).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * share).alias("y"))
