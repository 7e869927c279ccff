"""Explicit schemas of the inputs; a column that a file lacks reads as null. Column names are fixed values of the sources' formats."""

from __future__ import annotations

from pyspark.sql import types as T

_POINT = T.ArrayType(T.DoubleType())
FRAME_PLAYER = T.StructType(
    [T.StructField("location", _POINT), T.StructField("teammate", T.BooleanType()), T.StructField("position", T.StructType([T.StructField("name", T.StringType())]))]
)


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


EVENT = T.StructType(
    _fields(T.LongType(), "match_id competition_id season_id index")
    + _fields(T.StringType(), "id shot_key_pass_id type team player play_pattern")
    + _fields(T.LongType(), "period minute")
    + _fields(_POINT, "location pass_end_location")
    + _fields(T.BooleanType(), "under_pressure shot_first_time pass_through_ball pass_cross pass_shot_assist pass_goal_assist")
    + _fields(T.StringType(), "pass_recipient pass_outcome pass_type ball_receipt_outcome substitution_replacement shot_outcome shot_type shot_body_part")
    + _fields(T.DoubleType(), "shot_statsbomb_xg")
    + [T.StructField("shot_freeze_frame", T.ArrayType(FRAME_PLAYER))]
)
MATCH = T.StructType(
    _fields(T.LongType(), "match_id competition_id season_id") + _fields(T.DateType(), "match_date") + _fields(T.StringType(), "home_team away_team") + _fields(T.LongType(), "home_score away_score") + _fields(T.StringType(), "competition_stage")
)
COMPETITION = T.StructType(_fields(T.LongType(), "competition_id season_id") + _fields(T.StringType(), "country_name competition_name competition_gender season_name"))
LINEUP = T.StructType(_fields(T.LongType(), "match_id") + _fields(T.StringType(), "team player_name player_nickname"))
TRACKING = T.StructType(_fields(T.LongType(), "period frame") + _fields(T.DoubleType(), "time_s") + _fields(T.StringType(), "team player") + _fields(T.DoubleType(), "x y"))
DETECTION = T.StructType(_fields(T.LongType(), "segment frame track_id cls") + _fields(T.DoubleType(), "conf x1 y1 x2 y2") + _fields(T.BooleanType(), "on_grass") + _fields(T.DoubleType(), "L a b"))
#: Column names of the tracking provider's event feed and ours.
FEED_NAMES = {
    "Team": "team", "Type": "type", "Subtype": "subtype", "Period": "period", "Start Frame": "start_frame", "Start Time [s]": "start_s", "End Frame": "end_frame", "End Time [s]": "end_s",
    "From": "player_from", "To": "player_to", "Start X": "start_x", "Start Y": "start_y", "End X": "end_x", "End Y": "end_y",
}
FEED = T.StructType([T.StructField(n, T.StringType() if n in ("Team", "Type", "Subtype", "From", "To") else T.LongType() if n in ("Period", "Start Frame", "End Frame") else T.DoubleType()) for n in FEED_NAMES])
