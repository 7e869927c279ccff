"""Team shape, formations and space control. Groups are the players of one team on one frame or window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import possession as poss
from . import tracking as t

LEAST_PLAYERS = 8


def _cross(o: Column, a: Column, p: Column) -> Column:
    return (a["x"] - o["x"]) * (p["y"] - o["y"]) - (a["y"] - o["y"]) * (p["x"] - o["x"])


def _turning_left(points: Column) -> Column:
    """The points of a sorted list that its hull passes on one side: the monotone chain, as a fold whose state is the chain so far.

    A point takes from the chain's end all points at which the way to it doesn't turn left; in a chain that turns left everywhere these are the
    points past the tangent, so that each can be judged by itself.
    """
    none = F.expr("array()").cast("array<struct<x:double,y:double>>")
    stays = lambda chain, p: F.filter(chain, lambda e, i: (i == 0) | (_cross(F.get(chain, i - 1), e, p) > 0))
    return F.aggregate(points, none, lambda chain, p: F.concat(stays(chain, p), F.array(p)))


def hull_area(points: Column) -> Column:
    """Area of the convex hull of an array of (x, y); null for fewer than three points that aren't in a line."""
    ordered = F.array_sort(F.array_distinct(F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))))
    edge = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    round_it = lambda chain: F.aggregate(F.transform(chain, lambda p, i: F.when(i > 0, edge(F.get(chain, i - 1), p)).otherwise(0.0)), F.lit(0.0), lambda t, v: t + v)
    # Each chain once: a one-element list gives it a name.
    side = lambda of: F.get(F.transform(F.array(_turning_left(of)), round_it), F.lit(0))
    area = F.abs(side(ordered) + side(F.reverse(ordered))) / 2
    return F.when((F.size(ordered) > 2) & (area > 0), area)


def outfield(trk: DataFrame) -> DataFrame:
    return trk.join(t.goalkeepers(trk), list(t.PLAYER), "left_anti")


def team_shape(trk: DataFrame, step: int = 5, hull: bool = True) -> DataFrame:
    """Per team and every step-th frame: centroid, length, width and hull of the outfield players; all null with fewer than LEAST_PLAYERS."""
    rows = t.every(outfield(trk), step).groupBy("game", "team", "period", "frame").agg(
        F.count("x").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.max("x") - F.min("x")).alias("len"), (F.max("y") - F.min("y")).alias("wid"),
        F.collect_list(F.when(F.col("x").isNotNull(), F.struct("x", "y"))).alias("points"), F.first("time_s").alias("time_s"),
    )
    enough = lambda c: F.when(F.col("n") >= LEAST_PLAYERS, F.col(c))
    out = rows.select("game", "team", "period", "frame", "time_s", enough("n").alias("n_outfield"), enough("cx").alias("centroid_x"), enough("cy").alias("centroid_y"), enough("len").alias("length"), enough("wid").alias("width"), "points", "n")
    return (out.withColumn("hull_area", hull_area(enough("points"))) if hull else out).drop("points", "n")


def shape_by_possession(shape: DataFrame, held: DataFrame, columns: tuple[str, ...] = ("centroid_x", "length", "width", "hull_area")) -> DataFrame:
    """Mean, deviation and count of the shape in and out of possession."""
    joined = shape.join(held.select("game", "frame", "holder"), ["game", "frame"], "left").withColumn("state", poss.state())
    return joined.groupBy("game", "team", "state").agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))])


def rolling(shape: DataFrame, column: str, seconds: float, step: int, fps: float = t.FPS) -> DataFrame:
    """Trailing mean within a period."""
    n = max(1, int(seconds * fps / step))
    w = Window.partitionBy("game", "team", "period").orderBy("frame").rowsBetween(-(n - 1), 0)
    return shape.withColumn(f"{column}_rolling", F.avg(column).over(w))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Dealt by the columns into as many tasks as the session asks for: lists of few bytes may be much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _splits(n: int, k: int) -> Column:
    """All ways to cut n places into k runs: arrays of the k + 1 places where runs begin and end."""
    return F.array(*[F.array(*[F.lit(c) for c in (0, *cuts, n)]) for cuts in combinations(range(1, n), k - 1)])


def _run_sums(sums: str, a: Column, b: Column) -> Column:
    return F.get(F.col(sums), b) - F.get(F.col(sums), a)


def _spread(cuts: Column) -> Column:
    """Sum of squared distances from the runs' means, by running sums s1 of the depths and s2 of their squares."""
    of_run = lambda a, b: _run_sums("s2", a, b) - F.pow(_run_sums("s1", a, b), 2) / (b - a)
    runs = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda a, i: of_run(a, F.get(cuts, i + 1)))
    return F.aggregate(runs, F.lit(0.0), lambda t, v: t + v)


def _silhouette(cuts: Column) -> Column:
    """Mean silhouette of runs of sorted depths: distances within a run and to the neighbouring runs are differences of running sums."""

    def of_place(a: Column, b: Column, i: Column, before: Column, after: Column) -> Column:
        x = F.get(F.col("v"), i)
        inside = (x * (i - a) - _run_sums("s1", a, i) + _run_sums("s1", i + 1, b) - x * (b - i - 1)) / (b - a - 1)
        left = F.when(before.isNotNull(), x - _run_sums("s1", before, a) / (a - before))
        right = F.when(after.isNotNull(), _run_sums("s1", b, after) / (after - b) - x)
        nearest = F.least(left, right)  # a missing one is passed over
        return F.when((b - a > 1) & (F.greatest(nearest, inside) > 0), (nearest - inside) / F.greatest(nearest, inside)).otherwise(0.0)

    def of_run(a: Column, j: Column) -> Column:
        b, after = F.get(cuts, j + 1), F.get(cuts, j + 2)
        before = F.when(j > 0, F.get(cuts, j - 1))
        places = F.transform(F.sequence(a, b - 1), lambda i: F.when(b - a > 1, of_place(a, b, i, before, after)).otherwise(0.0))
        return F.aggregate(places, F.lit(0.0), lambda t, v: t + v)

    runs = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), of_run)
    return F.aggregate(runs, F.lit(0.0), lambda t, v: t + v) / F.size("v")


def with_lines(windows: DataFrame, ks: tuple[int, ...] = (2, 3, 4), players: int = 10) -> DataFrame:
    """Rows with v, the sorted depths of so many players, gain k, silhouette and cuts: lines of players by depth.

    In one dimension the best clusters are runs of the sorted values. For each k the split of the least spread is taken (of equal ones the first), and of these
    the one of the best silhouette (of equal ones the least k). Both are compared to nine places, so that ties are ties.
    """
    running = lambda of: F.aggregate(of, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    summed = windows.withColumns({"s1": running(F.col("v")), "s2": running(F.transform("v", lambda x: x * x))})
    best = F.array(*[F.struct(F.lit(k).alias("k"), F.array_min(F.transform(_splits(players, k), lambda c: F.struct(F.round(_spread(c), 9).alias("spread"), c.alias("cuts"))))["cuts"].alias("cuts")) for k in ks])
    scored = summed.withColumn("best", best).withColumn("scored", F.transform("best", lambda b: F.struct(F.round(_silhouette(b["cuts"]), 9).alias("silhouette"), (-b["k"]).alias("k"), b["cuts"].alias("cuts"))))
    chosen = scored.withColumn("best", F.array_max("scored"))
    return chosen.withColumns({"k": -F.col("best.k"), "silhouette": F.col("best.silhouette"), "cuts": F.col("best.cuts")}).drop("s1", "s2", "best", "scored")


def window_positions(trk: DataFrame, held: DataFrame, frames: int, least: int) -> DataFrame:
    """Mean position of each outfield player in each window of ``frames`` frames and possession state.

    Windows count frames from the period's start; a window and state needs ``least`` frames and just ten players who are there for 9 of 10 of them.
    """
    numbered = held.withColumn("window", F.floor((F.row_number().over(Window.partitionBy("game", "period").orderBy("frame")) - 1) / frames).cast("int"))
    rows = t.attack_relative(outfield(trk)).join(numbered.select("game", "frame", "window", "holder"), ["game", "frame"]).withColumn("state", poss.state()).where("state <> 'unknown/dead ball'")
    key = ["game", "team", "period", "window", "state"]
    players = rows.groupBy(*key, "player").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("x").alias("seen"), F.count(F.lit(1)).alias("frames"))
    there = players.where((F.col("frames") >= least) & (F.col("seen") / F.col("frames") >= 0.9))
    ten = there.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n = 10").drop("n")
    return there.join(ten, key).select(*key, "player", "x", "y", "frames")


def formations(positions: DataFrame, ks: tuple[int, ...] = (2, 3, 4), players: int = 10) -> DataFrame:
    """Lines of each window of so many players: formation (players a line, from the back), k, silhouette, and each player's line."""
    key = ["game", "team", "period", "window", "state"]
    windows = _dealt(positions, *key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("x", "player", "y", "frames"))).alias("players")).where(F.size("players") == players)
    found = with_lines(windows.withColumn("v", F.transform("players", lambda p: p["x"])), ks, players)
    sizes = F.transform(F.slice("cuts", 2, F.size("cuts") - 1), lambda c, i: (c - F.get("cuts", i)).cast("string"))
    spread = found.select(*key, "k", F.array_join(sizes, "-").alias("formation"), "silhouette", "cuts", F.posexplode("players").alias("place", "p"))
    line = F.size(F.filter("cuts", lambda c: c <= F.col("place"))) - 1
    return spread.select(*key, "p.frames", "k", "formation", "silhouette", "p.player", "p.x", "p.y", line.alias("line"))


def reliability(windows: DataFrame) -> DataFrame:
    """How often each team and state shows its most frequent formation; ties go to the first by name."""
    counts = windows.groupBy("team", "state", "formation").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("formation", "n"), F.struct(-F.col("n"), "formation"))
    out = counts.groupBy("team", "state").agg(F.sum("n").alias("windows"), best.alias("b"), F.count(F.lit(1)).alias("distinct_formations"))
    return out.select("team", "state", "windows", F.col("b.formation").alias("modal_formation"), F.round(F.col("b.n") / F.col("windows"), 2).alias("modal_share"), "distinct_formations")


def _frames_of(positions: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each frame's players with a place as one list, a squad at most, in the order of their names, which decides ties."""
    placed = positions.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    player = F.struct("team", "player", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _dealt(placed, *by).groupBy(*by).agg(F.array_sort(F.collect_list(player)).alias("players"))


def _owners(cell: float, n_x: int, n_y: int) -> Callable[[pa.ListArray], Iterator[tuple]]:
    """A function that takes frames' lists of players and gives, for some frames at a time, (first frame, first places in the lists, owned, start, stop).

    Along a row of cells squared distances differ by straight lines only, so that of two players the one further left is nearer up to a cell, and from
    there on the other: a player owns the cells from the last of these cuts against those further left to the first against those further right. The work is rows times pairs of
    players. start and stop have a row for each frame, player by place, and row of cells; owned tells places of a player.
    """
    import numpy as np

    FRAMES = 64

    def owners(lists):
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        xs, ys = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        middle = (np.arange(n_y) + 0.5) * cell
        for at in range(0, len(lists), FRAMES):
            first = offsets[at : at + FRAMES + 1]
            sizes = np.diff(first)
            most = int(sizes.max())
            owned = np.arange(most) < sizes[:, None]
            place = np.where(owned, first[:-1, None] + np.arange(most), first[0])
            x, y = xs[place], ys[place]
            # From left to right; of equal x the first by name.
            order = np.argsort(np.where(owned, x, np.inf), axis=1, kind="stable")
            x, y, owned = (np.take_along_axis(v, order, axis=1) for v in (x, y, owned))
            off = middle - y[:, :, None]
            c = (x * x)[:, :, None] + off * off
            start = np.zeros(c.shape)
            stop = np.full(c.shape, float(n_x))
            for j in range(1, most):
                for i in range(j):
                    both, same = owned[:, i] & owned[:, j], x[:, i] == x[:, j]
                    wins = order[:, j] < order[:, i]
                    gap = np.where(same | ~both, 1.0, 2 * (x[:, j] - x[:, i]))[:, None]
                    k = (c[:, j] - c[:, i]) / gap / cell - 0.5
                    cut = np.where(wins[:, None], np.ceil(k), np.floor(k) + 1)
                    if same.any():
                        nearer = (c[:, j] < c[:, i]) | ((c[:, j] == c[:, i]) & wins[:, None])
                        cut = np.where(same[:, None], np.where(nearer, -1.0, float(n_x)), cut)
                    cut_j, cut_i = (np.where(both[:, None], cut, none) for none in (-np.inf, np.inf))
                    np.maximum(start[:, j], cut_j, out=start[:, j])
                    np.minimum(stop[:, i], cut_i, out=stop[:, i])
            yield at, np.take_along_axis(place, order, axis=1), owned[:, :, None] & (start < stop), start, stop

    return owners


def _grid_of(cell: float, length: float, width: float) -> tuple[int, int]:
    return round(length / cell), round(width / cell)


def control(positions: DataFrame, by: tuple[str, ...] = ("game",), cell: float = 0.5, length: float = g.LENGTH, width: float = g.WIDTH) -> DataFrame:
    """(by, iy, start, stop, team, player): runs of cells start, ..., stop - 1 of a grid's row iy whose nearest player is the same.

    Ties go to the first by team and player; players without a place are passed over.
    """
    n_x, n_y = _grid_of(cell, length, width)
    owners = _owners(cell, n_x, n_y)
    frames = _frames_of(positions, by)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            for at, place, owned, start, stop in owners(lists):
                frame, player, iy = np.nonzero(owned)
                of = pa.array(at + frame)
                who = flat.take(pa.array(place[frame, player]))
                ints = [pa.array(v.astype(np.int32)) for v in (iy, start[owned], stop[owned])]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(of) for i in range(len(by))], *ints, who.field("team"), who.field("player")], [*by, "iy", "start", "stop", "team", "player"])

    types = dict(frames.dtypes)
    return frames.select(*by, "players").mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in by], "iy int, start int, stop int, team string, player string"]))


def control_of_frames(positions: DataFrame, by: tuple[str, ...] = ("game",), cell: float = 0.5, length: float = g.LENGTH, width: float = g.WIDTH) -> DataFrame:
    """(by, home_share): as ``control_share`` of ``control``, counted where the runs are found, so that none of them is moved."""
    n_x, n_y = _grid_of(cell, length, width)
    owners = _owners(cell, n_x, n_y)
    frames = _frames_of(positions, by)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            away = pc.fill_null(pc.equal(lists.flatten().field("team"), "away"), False).to_numpy(zero_copy_only=False)
            shares = []
            for _, place, owned, start, stop in owners(lists):
                cells = np.where(owned, stop - start, 0.0).sum(axis=2)
                shares.append(1 - np.where(away[place], cells, 0.0).sum(axis=1) / cells.sum(axis=1))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(by))], pa.array(np.concatenate(shares))], [*by, "home_share"])

    types = dict(frames.dtypes)
    return frames.select(*by, "players").mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in by], "home_share double"]))


def control_cells(runs: DataFrame) -> DataFrame:
    """A row a cell: ix in place of start and stop."""
    kept = [c for c in runs.columns if c not in ("start", "stop")]
    return runs.select(*kept, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("ix"))


def control_share(runs: DataFrame, by: tuple[str, ...] = ("game",)) -> DataFrame:
    """Share of the cells that are not the away team's."""
    cells = F.col("stop") - F.col("start")
    return runs.groupBy(*by).agg((1 - F.sum(F.when(F.col("team") == "away", cells).otherwise(0)) / F.sum(cells)).alias("home_share"))
