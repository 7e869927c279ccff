"""Pitch geometry as column expressions. Event pitch: 120 x 80, attacking x = 120; metres: length x width."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GOAL_X, GOAL_Y, POST_LOW, POST_HIGH = 120.0, 40.0, 36.0, 44.0
LENGTH, WIDTH = 105.0, 68.0


def shot_distance(x: Column, y: Column) -> Column:
    dx, dy = GOAL_X - x, GOAL_Y - y
    return F.sqrt(dx * dx + dy * dy)


def shot_angle(x: Column, y: Column, atan2: Callable[[Column, Column], Column] = F.atan2) -> Column:
    """Angle between the posts as seen from (x, y): pi between the posts on the line, 0 outside on it."""
    dx, low, high = GOAL_X - x, POST_LOW - y, POST_HIGH - y
    return atan2(F.abs(dx * high - low * dx), dx * dx + low * high)


def _side(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (px - bx) * (ay - by) - (ax - bx) * (py - by)


def in_shot_cone(px: Column, py: Column, x: Column, y: Column) -> Column:
    """Whether (px, py) lies in the triangle of the shooter and the posts; its edge counts as inside."""
    gx, low, high = F.lit(GOAL_X), F.lit(POST_LOW), F.lit(POST_HIGH)
    sides = [_side(px, py, x, y, gx, low), _side(px, py, gx, low, gx, high), _side(px, py, gx, high, x, y)]
    left, right = sides[0] < 0, sides[0] > 0
    for s in sides[1:]:
        left, right = left | (s < 0), right | (s > 0)
    return ~(left & right)


def rescale(x: Column, y: Column, old: tuple[float, float], new: tuple[float, float]) -> tuple[Column, Column]:
    return x * (new[0] / old[0]), y * (new[1] / old[1])


def events_to_metres(x: Column, y: Column, length: float = LENGTH, width: float = WIDTH) -> tuple[Column, Column]:
    return x / 120.0 * length, y / 80.0 * width


def unit_to_metres(x: Column, y: Column, length: float = LENGTH, width: float = WIDTH) -> tuple[Column, Column]:
    return x * length, y * width


def unit_to_events(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 120.0, y * 80.0


def tracking_to_metres(x: Column, y: Column, length: float = LENGTH, width: float = WIDTH) -> tuple[Column, Column]:
    """The tracking files' y runs downwards."""
    return x * length, (1 - y) * width


def flip_events(x: Column, y: Column) -> tuple[Column, Column]:
    return 120.0 - x, 80.0 - y


def turned(x: Column, y: Column, when: Column, length: float = LENGTH, width: float = WIDTH) -> tuple[Column, Column]:
    """Turn the pitch by 180 degrees where ``when`` holds."""
    return F.when(when, length - x).otherwise(x), F.when(when, width - y).otherwise(y)


def apply_h(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Projective map of a point by a 3 x 3 matrix, row by row in an array of 9."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def feet(cls: Column, x1: Column, y1: Column, x2: Column, y2: Column, ball: int = 32) -> tuple[Column, Column]:
    """Where a detection touches the ground: the middle of the lower edge, of the ball the centre."""
    return (x1 + x2) / 2, F.when(cls == ball, (y1 + y2) / 2).otherwise(y2)
