"""Player tracking in long form: (game, period, frame, time_s, team, player, x, y), a row for each frame of a player, null where the track is lost.

Every window is within a player's period, a player, or a game; none spans games.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .quantiles import column_quantiles

FPS = 25.0
PLAYER = ("game", "team", "player")
MEDIAN_ROWS, MEDIAN_LEAST, GLITCH_M = 17, 5, 2.0
MAX_GAP, MAX_SPEED = 25, 12.0
SMOOTH = 13
SPRINT_SPEED, SPRINT_S = 7.0, 1.0
#: Upper edges in km/h; a zone holds its lower edge.
ZONES = (("walking", 7.2), ("jogging", 14.4), ("running", 19.8), ("high_speed", 25.2), ("sprinting", None))


def _period() -> Window:
    return Window.partitionBy(*PLAYER, "period").orderBy("frame")


def _whole() -> Window:
    return Window.partitionBy(*PLAYER).orderBy("frame")


def directions(trk: DataFrame, length: float = g.LENGTH) -> DataFrame:
    """(game, period, direction): 1 if the home side starts the period in the left half, else -1."""
    first = trk.groupBy("game", "period").agg(F.min("frame").alias("first"))
    start = trk.where("team = 'home'").join(first, ["game", "period"]).where("frame = first")
    return start.groupBy("game", "period").agg(F.when(F.avg("x") < length / 2, 1).otherwise(-1).alias("direction"))


def home_attacks_right(trk: DataFrame, length: float = g.LENGTH, width: float = g.WIDTH) -> DataFrame:
    """Turn the periods in which the home side starts on the right."""
    joined = trk.join(directions(trk, length), ["game", "period"], "left")
    x, y = g.turned(F.col("x"), F.col("y"), F.coalesce(F.col("direction") == -1, F.lit(False)), length, width)
    return joined.withColumns({"x": x, "y": y}).drop("direction")


def attack_relative(trk: DataFrame, length: float = g.LENGTH, width: float = g.WIDTH) -> DataFrame:
    """Turn the away side, so that both attack to the right."""
    x, y = g.turned(F.col("x"), F.col("y"), F.col("team") == "away", length, width)
    return trk.withColumns({"x": x, "y": y})


def step_speed(trk: DataFrame, within_period: bool, fps: float = FPS) -> DataFrame:
    """Rows with step: speed from the frame before; the raw version also counts the step across the break."""
    w = _period() if within_period else _whole()
    return trk.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * fps)


def frame_rate(trk: DataFrame) -> float:
    """Frames a second: one by the median time between a game's frames that follow each other."""
    times = trk.select("game", "frame", "time_s").distinct()
    step = F.col("time_s") - F.lag("time_s").over(Window.partitionBy("game").orderBy("frame"))
    return times.select(step.alias("step")).agg(F.round(1 / F.median("step"), 3)).first()[0]


def frame_rates(trk: DataFrame) -> DataFrame:
    """(game, fps): each game's frames a second, by the median time between frames that follow each other; null for a game of one frame."""
    times = trk.select("game", "frame", "time_s").distinct()
    step = F.col("time_s") - F.lag("time_s").over(Window.partitionBy("game").orderBy("frame"))
    return times.select("game", step.alias("step")).groupBy("game").agg(F.round(1 / F.median("step"), 3).alias("fps"))


def frame_gaps(trk: DataFrame) -> DataFrame:
    frames = trk.select("game", "frame").distinct()
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy("game").orderBy("frame"))
    return frames.select("game", gap.alias("gap")).groupBy("game").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("gap") != 1).alias("frame_gaps"))


def quality(trk: DataFrame, fps: float = FPS, length: float = g.LENGTH, width: float = g.WIDTH) -> DataFrame:
    """Per game and team: squad, players on the pitch, missing and outside shares, frozen frames, impossible steps.

    A frame is frozen if no player moves; a game's first frame, which has none before it, counts as one.
    """
    outside = (F.col("x") < 0) | (F.col("x") > length) | (F.col("y") < 0) | (F.col("y") > width)
    w = _whole()
    moved = F.abs(F.col("x") - F.lag("x").over(w)) + F.abs(F.col("y") - F.lag("y").over(w))
    rows = step_speed(trk, False, fps).withColumn("moved", F.coalesce(moved, F.lit(0.0)))
    frames = rows.groupBy("game", "team", "frame").agg(F.count("x").alias("on_pitch"), F.sum("moved").alias("moved"))
    by_frame = frames.groupBy("game", "team").agg(F.max("on_pitch").alias("max_players"), F.count_if(F.col("on_pitch") < 11).alias("frames_under_11"), F.count_if(F.col("moved") == 0).alias("frozen_frames"))
    by_row = rows.groupBy("game", "team").agg(
        F.count_distinct("player").alias("squad"), F.avg(F.col("x").isNull().cast("double")).alias("missing_share"), F.avg(outside.cast("double")).alias("outside_share"),
        F.count_if(F.col("step") > MAX_SPEED).alias("steps_over_max"), F.max("step").alias("max_step"),
    )
    return by_row.join(by_frame, ["game", "team"])


def rolling_median(trk: DataFrame) -> DataFrame:
    """Rows with mx, my: the centred median of a period's rows, null with fewer than MEDIAN_LEAST values."""
    half = MEDIAN_ROWS // 2
    w = _period().rowsBetween(-half, half)
    med = lambda c: F.when(F.count(c).over(w) >= MEDIAN_LEAST, F.percentile(c, 0.5).over(w))
    return trk.withColumns({"mx": med("x"), "my": med("y")})


def repair(trk: DataFrame, bad: Column, fps: float = FPS) -> DataFrame:
    """Blank the bad points, then bridge each run of them by a straight line.

    A run is bridged if it is MAX_GAP long at most, both neighbours are known, and the speed between them is possible. left tells which points stay missing.
    """
    w = _period()
    marked = trk.withColumn("bad", F.coalesce(bad, F.lit(False)))
    marked = marked.withColumn("run", F.sum(F.when(F.col("bad") != F.lag("bad", 1, False).over(w), 1).otherwise(0)).over(w))
    blank = marked.withColumns({c: F.when(~F.col("bad"), F.col(c)) for c in ("x", "y")})
    near = blank.withColumns({"__px": F.lag("x").over(w), "__py": F.lag("y").over(w), "__nx": F.lead("x").over(w), "__ny": F.lead("y").over(w)})
    whole = Window.partitionBy(*PLAYER, "period", "run").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.partitionBy(*PLAYER, "period", "run").orderBy("frame")
    run = near.withColumns(
        {"__ax": F.first("__px").over(whole), "__ay": F.first("__py").over(whole), "__bx": F.last("__nx").over(whole), "__by": F.last("__ny").over(whole), "__n": F.count(F.lit(1)).over(whole), "__i": F.row_number().over(so_far)}
    )
    possible = F.hypot(F.col("__bx") - F.col("__ax"), F.col("__by") - F.col("__ay")) <= MAX_SPEED * (F.col("__n") + 1) / fps
    bridged = F.col("bad") & F.coalesce((F.col("__n") <= MAX_GAP) & possible, F.lit(False))
    line = lambda c: F.when(bridged, F.col(f"__a{c}") + (F.col(f"__b{c}") - F.col(f"__a{c}")) * F.col("__i") / (F.col("__n") + 1)).otherwise(F.col(c))
    return run.select(*[c for c in trk.columns if c not in ("x", "y")], line("x").alias("x"), line("y").alias("y"), F.col("bad"), (F.col("bad") & ~bridged).alias("left"))


def _fast(fps: float) -> Column:
    w = _period()
    step = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")) * fps
    before = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * fps
    return F.coalesce(step > MAX_SPEED, F.lit(False)) | F.coalesce(before > MAX_SPEED, F.lit(False))


def despike(trk: DataFrame, fps: float = FPS) -> DataFrame:
    """Cleaned rows with flagged, blanked and left: points off their median, points at impossible steps, points that stay missing.

    Two rounds take out the ends of impossible steps; a round without any changes nothing. All windows share one
    partitioning, so the rows are shuffled once.
    """
    columns = [c for c in trk.columns if c not in ("x", "y")]
    off = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) > GLITCH_M
    now = repair(rolling_median(trk), off, fps).select(*columns, "x", "y", F.col("bad").cast("int").alias("flagged"), F.lit(0).alias("blanked"), F.col("left").cast("int").alias("lost"))
    for _ in range(2):
        again = repair(now.withColumn("__fast", _fast(fps)), F.col("__fast"), fps)
        now = again.select(*columns, "x", "y", "flagged", (F.col("blanked") + F.col("bad").cast("int")).alias("blanked"), (F.col("lost") + F.col("left").cast("int")).alias("lost"))
    return now


def raw_kinematics(trk: DataFrame, fps: float = FPS) -> DataFrame:
    """Plain differences: speed and accel, null across a break."""
    stepped = step_speed(trk, True, fps).withColumnRenamed("step", "speed")
    return stepped.withColumn("accel", F.abs(F.col("speed") - F.lag("speed").over(_whole())) * fps)


def smooth_kinematics(trk: DataFrame, fps: float = FPS) -> DataFrame:
    """Speed and accel off a quadratic fitted to SMOOTH rows, where all of them are known.

    First and second derivative of the fit are weighted sums of the rows: weights i / S2 and 2 (i^2 - S2 / n) / S, of the offsets i.
    """
    h = SMOOTH // 2
    offsets = range(-h, h + 1)
    s2 = sum(i * i for i in offsets)
    mean = s2 / SMOOTH
    s4 = sum((i * i - mean) ** 2 for i in offsets)
    w = _period()
    at = {(c, i): (F.col(c) if i == 0 else F.lag(c, -i).over(w) if i < 0 else F.lead(c, i).over(w)) for c in ("x", "y") for i in offsets}
    first = lambda c: sum((i * at[c, i] for i in offsets if i), F.lit(0.0)) * (fps / s2)
    second = lambda c: sum(((i * i - mean) * at[c, i] for i in offsets), F.lit(0.0)) * (2 * fps * fps / s4)
    known = F.count("x").over(w.rowsBetween(-h, h)) == SMOOTH
    return trk.withColumns({"speed": F.when(known, F.hypot(first("x"), first("y"))), "accel": F.when(known, F.hypot(second("x"), second("y")))})


def noise(kinematics: DataFrame, speed_max: float = MAX_SPEED, accel_max: float = 10.0) -> DataFrame:
    """99th percentile, maximum and share beyond a bound of speed and accel, over all known values."""
    out = []
    for c, most in (("speed", speed_max), ("accel", accel_max)):
        out += [F.max(c).alias(f"{c}_max"), F.avg((F.col(c) > most).cast("double")).alias(f"{c}_over")]
    p99 = column_quantiles(kinematics, ("speed", "accel"), (0.99,), ("game",)).select(F.col("game").alias("of_game"), *[F.col(c)[0].alias(f"{c}_p99") for c in ("speed", "accel")])
    joined = kinematics.groupBy("game").agg(*out).join(p99, F.col("game").eqNullSafe(F.col("of_game")), "left")
    return joined.select("game", *[f"{c}_{n}" for c in ("speed", "accel") for n in ("p99", "max", "over")])


def goalkeepers(trk: DataFrame) -> DataFrame:
    """(game, team, player): who is nearest his own goal on average."""
    means = trk.groupBy(*PLAYER).agg(F.avg("x").alias("mean_x")).where(F.col("mean_x").isNotNull())
    depth = F.when(F.col("team") == "home", F.col("mean_x")).otherwise(-F.col("mean_x"))
    return means.groupBy("game", "team").agg(F.min_by("player", F.struct(depth.alias("depth"), "player")).alias("player"))


def runs(rows: DataFrame, condition: Column, window: Window) -> DataFrame:
    """Rows on which the condition holds, with island: the number of the run of such rows that each is in."""
    held = F.coalesce(condition, F.lit(False))
    marked = rows.withColumn("__held", held)
    starts = F.when(F.col("__held") & ~F.lag("__held", 1, False).over(window), 1).otherwise(0)
    return marked.withColumn("island", F.sum(starts).over(window)).where("__held").drop("__held")


def sprints(kinematics: DataFrame, fps: float = FPS) -> DataFrame:
    """(game, team, player, sprints): runs at SPRINT_SPEED or more that last SPRINT_S or longer."""
    found = runs(kinematics, F.col("speed") >= SPRINT_SPEED, _whole()).groupBy(*PLAYER, "island").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= round(SPRINT_S * fps)).groupBy(*PLAYER).agg(F.count(F.lit(1)).alias("sprints"))


def zone(kmh: Column) -> Column:
    out = F
    for name, edge in ZONES:
        out = out.when(kmh < edge, name) if edge else out.otherwise(name)
    return F.when(kmh.isNotNull(), out)


def physical_table(kinematics: DataFrame, keepers: DataFrame, fps: float = FPS) -> DataFrame:
    """Running load of each player with any known speed."""
    known = kinematics.where(F.col("speed").isNotNull()).withColumns({"metres": F.col("speed") / fps, "zone": zone(F.col("speed") * 3.6)})
    sums = [F.round(F.coalesce(F.sum(F.when(F.col("zone") == name, F.col("metres"))), F.lit(0.0)), 0).alias(f"dist_{name}_m") for name, _ in ZONES]
    table = known.groupBy(*PLAYER).agg(F.round(F.count(F.lit(1)) / fps / 60, 1).alias("minutes"), F.round(F.sum("metres"), 0).alias("distance_m"), F.round(F.max("speed") * 3.6, 1).alias("top_speed_kmh"), *sums)
    marked = table.join(keepers.withColumn("is_gk", F.lit(True)), list(PLAYER), "left").join(sprints(kinematics, fps), list(PLAYER), "left")
    return marked.withColumns({"is_gk": F.coalesce("is_gk", F.lit(False)), "sprints": F.coalesce("sprints", F.lit(0)).cast("long")})


def full_match_range(table: DataFrame, minutes: float) -> DataFrame:
    """Least and most distance of the outfield players with more than so many minutes."""
    return table.where(~F.col("is_gk") & (F.col("minutes") > minutes)).groupBy("game").agg(F.count(F.lit(1)).alias("players"), F.min("distance_m").alias("least"), F.max("distance_m").alias("most"))


def positions_at(trk: DataFrame, frame: int) -> DataFrame:
    return trk.where((F.col("frame") == frame) & F.col("x").isNotNull()).select("game", "team", "player", "x", "y")


def every(rows: DataFrame, k: int, by: tuple[str, ...] = ("game",)) -> DataFrame:
    """Every k-th frame by position, beginning with the first."""
    frames = rows.select(*by, "frame").distinct()
    at = F.row_number().over(Window.partitionBy(*by).orderBy("frame")) - 1
    return rows.join(frames.withColumn("__at", at).where(F.col("__at") % k == 0).drop("__at"), [*by, "frame"])
