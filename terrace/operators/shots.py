"""Shot features: who leads, what assisted, where the defenders stand. All windows stay within a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import libm
from ..functions import text

SHOOT_OUT = 5
FEATURES = ("distance", "angle", "first_time", "follows_through_ball", "follows_cross", "under_pressure", "minute", "score_diff")
FREEZE_FEATURES = ("ff_defenders_in_cone", "ff_gk_in_cone", "ff_gk_distance", "ff_nearest_defender")
CATEGORIES = ("body_part", "shot_type", "play_pattern")


def is_goal() -> Column:
    return F.coalesce(F.col("shot_outcome") == "Goal", F.lit(False))


def shot_table(events: DataFrame) -> DataFrame:
    """All shots with their goal flag."""
    return events.where(F.col("type") == "Shot").withColumn("is_goal", is_goal().cast("int"))


def modelled(events: DataFrame) -> DataFrame:
    """Shots but for penalties and the shoot-out; a shot of unknown type is modelled."""
    return shot_table(events).where(~F.col("shot_type").eqNullSafe("Penalty") & (F.col("period") != SHOOT_OUT))


def penalties(events: DataFrame) -> DataFrame:
    return shot_table(events).where((F.col("shot_type") == "Penalty") & (F.col("period") != SHOOT_OUT))


def goals(events: DataFrame) -> DataFrame:
    """Goals that count: shots in play and own goals, which the feed books to the team that gains."""
    scored = (F.col("type") == "Shot") & is_goal() & (F.col("period") != SHOOT_OUT)
    return events.where(scored | (F.col("type") == "Own Goal For"))


def exclusion_counts(events: DataFrame) -> DataFrame:
    """One row: all shots, shoot-out kicks, penalties in play, and the modelled rest."""
    shoot_out = F.col("period") == SHOOT_OUT
    penalty = F.col("shot_type").eqNullSafe("Penalty") & ~shoot_out
    return shot_table(events).agg(F.count(F.lit(1)).alias("all_shots"), F.count_if(penalty).alias("penalties"), F.count_if(shoot_out).alias("shootout_kicks"), F.count_if(~penalty & ~shoot_out).alias("modelled"))


def with_score_diff(events: DataFrame) -> DataFrame:
    """Events with score_diff: own goals less the opponent's before the event, by two running sums instead of a theta join."""
    scored = F.when(((F.col("type") == "Shot") & is_goal() & (F.col("period") != SHOOT_OUT)) | (F.col("type") == "Own Goal For"), 1).otherwise(0)
    both = Window.partitionBy("match_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("match_id", "team").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    counted = events.withColumn("__goal", scored)
    diff = 2 * F.coalesce(F.sum("__goal").over(own), F.lit(0)) - F.coalesce(F.sum("__goal").over(both), F.lit(0))
    return counted.withColumn("score_diff", diff.cast("int")).drop("__goal")


def with_key_pass(shots: DataFrame, events: DataFrame) -> DataFrame:
    """Shots with the flags of the pass that key_pass_id names; no such pass is no flag."""
    passes = events.where(F.col("type") == "Pass").groupBy(F.col("match_id").alias("pass_match"), F.col("idx").alias("pass_idx")).agg(F.max("pass_through_ball").alias("through"), F.max("pass_cross").alias("cross"))
    joined = shots.join(passes, (F.col("match_id") == F.col("pass_match")) & (F.col("key_pass_id") == F.col("pass_idx")), "left")
    return joined.withColumns({"follows_through_ball": text.flag(F.col("through")), "follows_cross": text.flag(F.col("cross"))}).drop("pass_match", "pass_idx", "through", "cross")


def freeze_frame(frame: Column, x: Column, y: Column) -> dict[str, Column]:
    """Features of an array of (px, py, teammate, is_gk); all null if it is null or empty."""
    opponents = F.filter(frame, lambda p: ~p["teammate"])
    keepers, field = F.filter(opponents, lambda p: p["is_gk"]), F.filter(opponents, lambda p: ~p["is_gk"])
    keeper = F.get(keepers, F.lit(0))
    known = F.coalesce(F.size(frame) > 0, F.lit(False))
    inside = F.size(F.filter(field, lambda p: g.in_shot_cone(p["px"], p["py"], x, y)))
    nearest = F.array_min(F.transform(field, lambda p: F.hypot(p["px"] - x, p["py"] - y)))
    of_keeper = known & keeper.isNotNull()
    return {
        "ff_defenders_in_cone": F.when(known, inside.cast("double")),
        "ff_gk_in_cone": F.when(of_keeper, g.in_shot_cone(keeper["px"], keeper["py"], x, y).cast("double")),
        "ff_gk_distance": F.when(of_keeper, g.shot_distance(keeper["px"], keeper["py"])),
        "ff_nearest_defender": F.when(known, nearest),
    }


def feature_columns(freeze: bool = False) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Numeric and categorical features; with the freeze frame's features if asked."""
    return FEATURES + (FREEZE_FEATURES if freeze else ()), CATEGORIES


def dataset(events: DataFrame) -> DataFrame:
    """One row per modelled shot: keys, features, label, and the provider's probability as a benchmark, which is no feature.

    The freeze frame's features are null if events have no ``frame``, and so are keys and benchmark that events lack.
    """
    shots = modelled(with_score_diff(events))
    shots = with_key_pass(shots, events)
    optional = {"competition_id": "int", "season_id": "int", "play_pattern": "string", "sb_xg": "double"}
    shots = shots.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in shots.columns})
    frames = freeze_frame(F.col("frame"), F.col("x"), F.col("y")) if "frame" in shots.columns else {c: F.lit(None).cast("double") for c in FREEZE_FEATURES}
    return shots.select(
        "match_id", "competition_id", "season_id", "idx", "team", "player", "period", "x", "y",
        g.shot_distance(F.col("x"), F.col("y")).alias("distance"), g.shot_angle(F.col("x"), F.col("y")).alias("angle"),
        text.flag(F.col("first_time")).alias("first_time"), "follows_through_ball", "follows_cross", text.flag(F.col("under_pressure")).alias("under_pressure"),
        "minute", "score_diff", text.body_part(F.col("shot_body_part")).alias("body_part"), text.shot_type(F.col("shot_type")).alias("shot_type"), "play_pattern",
        *[frames[c].alias(c) for c in FREEZE_FEATURES], "is_goal", "sb_xg",
    )


def closed_form_xg(x: Column, y: Column) -> Column:
    """A fixed logistic score of distance and angle, for queries that need a probability without a fitted model; to the last bit as SQL has it, since it is ranked."""
    return 1 / (1 + libm.exp(0.12 * g.shot_distance(x, y) - 1.5 * g.shot_angle(x, y, libm.atan2) + 0.5))


def dense_freeze_frames(events: DataFrame, rows: int = 5) -> DataFrame:
    """Events with a frame made of the match's previous rows, for tables that carry none."""
    before = Window.partitionBy("match_id").orderBy("idx").rowsBetween(-rows, -1)
    seen = F.struct(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("idx") % 3 == 0).alias("teammate"), (F.col("idx") % 4 == 0).alias("is_gk"))
    return events.withColumn("frame", F.collect_list(seen).over(before))
