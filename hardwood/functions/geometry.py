"""Boxes, points and court geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Court size and basket centres in feet, the margin of the in-bounds test.
COURT_LENGTH, COURT_WIDTH = 94.0, 50.0
BASKETS = {"left": (5.25, 25.0), "right": (88.75, 25.0)}
MARGIN_FT, CM_PER_FT, M_PER_FT = 6.0, 30.48, 0.3048

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where either is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def ios(a: Box, b: Box) -> Column:
    """Intersection over the smaller box."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(F.lit(0.0))


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def foot_point(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, b[3]


def rim_radius(b: Box) -> Column:
    return F.greatest((b[3] - b[1]) / 2, F.lit(8.0))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def edge_distance(b: Box, x: Column, y: Column, margin: float = 15.0) -> Column:
    """How far a point lies outside a box widened by ``margin``, in box heights; null without a point or box."""
    dx = F.greatest(b[0] - margin - x, x - b[2] - margin, F.lit(0.0))
    dy = F.greatest(b[1] - margin - y, y - b[3] - margin, F.lit(0.0))
    # greatest() passes over nulls, so a missing point must be told apart.
    there = x.isNotNull() & y.isNotNull() & b[0].isNotNull() & b[1].isNotNull() & b[2].isNotNull() & b[3].isNotNull()
    return F.when(there, F.sqrt(dx * dx + dy * dy) / F.greatest(b[3] - b[1], F.lit(1.0)))


def in_bounds(x: Column, y: Column, margin: float = MARGIN_FT) -> Column:
    return x.between(-margin, COURT_LENGTH + margin) & y.between(-margin, COURT_WIDTH + margin)


def project(h: list[float], u: Column, v: Column) -> tuple[Column, Column]:
    """Perspective projection by a row-major 3x3 matrix; null where the scale is 0."""
    w = F.nullif(h[6] * u + h[7] * v + h[8], F.lit(0.0))
    return (h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w


def segment_projection(ax, ay, bx, by, px, py) -> tuple[Column, Column]:
    """Place of a point along a segment (0 to 1) and its distance from it; null for a point segment."""
    sx, sy = bx - ax, by - ay
    length = sx * sx + sy * sy
    t = F.when(length >= 1e-9, ((px - ax) * sx + (py - ay) * sy) / length)
    return t, distance(px, py, ax + t * sx, ay + t * sy)


def angle_between(ax, ay, bx, by) -> Column:
    """Degrees between two vectors; null if either is shorter than 1e-6."""
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (na * nb)))
    return F.when((na >= 1e-6) & (nb >= 1e-6), F.degrees(F.acos(cos)))


def nearest_basket(x: Column, y: Column) -> Column:
    (lx, ly), (rx, ry) = BASKETS["left"], BASKETS["right"]
    return F.when(distance(x, y, F.lit(lx), F.lit(ly)) <= distance(x, y, F.lit(rx), F.lit(ry)), "left").otherwise("right")


def classify_screen(approach: Column, angle: Column, min_approach: float = 3.0, back_angle: float = 60.0) -> Column:
    return F.when(approach > min_approach, "down").when(angle.isNull(), "undefined").when(angle < back_angle, "back").otherwise("front")


def feet_to_metres(c: Column) -> Column:
    return c * M_PER_FT


def cm_to_feet(c: Column) -> Column:
    return c / CM_PER_FT


# Least side of a usable crop in pixels, least confidence of a wrist, error of an inlier in pixels.
LEAST_CROP, WRIST_SURE, INLIER_PX = 16, 0.30, 15.0
# The court grid's columns and rows, the court's length and width, the first gap of its rows and how each grows (cm).
GRID, GRID_CM, FIRST_GAP, GAP_GROWTH = (13, 7), (2800.0, 1500.0), 175.0, 30.0


def large_enough(b: Box, least: int = LEAST_CROP) -> Column:
    return (b[2] - b[0] >= least) & (b[3] - b[1] >= least)


def sure_wrists(wrists: Column, least: float = WRIST_SURE) -> Column:
    """Of an array of points with confidences those that are sure enough."""
    return F.filter(wrists, lambda w: w["confidence"] >= least)


def letterboxed(x: Column, y: Column, video: tuple[Column, Column], canvas: tuple[Column, Column]) -> tuple[Column, Column]:
    """Where a point of a video falls on a canvas that shows all of it, as large as possible and centred."""
    scale = F.least(canvas[0] / video[0], canvas[1] / video[1])
    return (canvas[0] - video[0] * scale) / 2 + x * scale, (canvas[1] - video[1] * scale) / 2 + y * scale


def circle_points(x: Column, y: Column, radius: Column, n: int = 61) -> Column:
    """``n`` points along a circle, the last again the first."""
    turn = lambda k: 2 * math.pi * k / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((x + radius * F.cos(turn(k))).alias("x"), (y + radius * F.sin(turn(k))).alias("y")))


def grid_point(i: Column) -> tuple[Column, Column]:
    """Place in feet of point ``i`` (0 to 90) of the court grid: rows lie farther apart from one to the next."""
    row = F.floor(i / GRID[0])
    down = row * FIRST_GAP + row * (row - 1) / 2 * GAP_GROWTH
    return cm_to_feet((i % GRID[0]) * GRID_CM[0] / (GRID[0] - 1)), cm_to_feet(GRID_CM[1] - down)


def project_back(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Place in the image of a place on the court by the inverse of ``h`` (9 numbers, image to court); null where there is none."""
    rows = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    m = [h[a] * h[b] - h[c] * h[d] for a, b, c, d in rows]
    det = h[0] * m[0] + h[1] * m[3] + h[2] * m[6]
    w = F.when(det != 0, F.nullif(m[6] * x + m[7] * y + m[8], F.lit(0.0)))
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def is_inlier(u: Column, v: Column, seen_u: Column, seen_v: Column, most: float = INLIER_PX) -> Column:
    """Whether a seen point lies by where it should; null where nothing was seen, which is written as (0, 0)."""
    return F.when((seen_u != 0) | (seen_v != 0), distance(u, v, seen_u, seen_v) < most)


def hex_channel(c: Column, i: int) -> Column:
    """Channel 0, 1 or 2 of a colour like #a0b1c2, null if it is not one."""
    digits = F.ltrim(c, F.lit("#"))
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int"))


def jersey_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d{1,2}", 0), F.lit("")).cast("int")
