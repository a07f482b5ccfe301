"""Column functions over planes, cells, boxes and polygons (all JVM-side)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compass names of eight directions, from east clockwise on a plane whose y grows downwards.
COMPASS = ("east", "south-east", "south", "south-west", "west", "north-west", "north", "north-east")


def axis_cell(value: Column, extent: float, cells: int) -> Column:
    inside = F.least(F.lit(extent), F.greatest(F.lit(0.0), value))
    return F.least(F.lit(cells - 1), F.floor(inside / F.lit(extent) * F.lit(cells))).cast("int")


def on_plane(x: Column, y: Column, width: float, height: float) -> Column:
    eps = max(width, height, 1.0) * 1e-9
    return x.between(-eps, width + eps) & y.between(-eps, height + eps)


def grid_cell(x: Column, y: Column, width: float, height: float, grid_width: int, grid_height: int) -> Column:
    """struct(row, col) of the cell, null off the plane."""
    return F.when(on_plane(x, y, width, height), F.struct(axis_cell(y, height, grid_height).alias("row"), axis_cell(x, width, grid_width).alias("col")))


def bottom_center(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> list[Column]:
    bound = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(top - 1.0), v))
    return [bound(x1, width), bound(y1, height), bound(x2, width), bound(y2, height)]


def project(x: Column, y: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """A homography's image of a point; null where the point has none."""
    row = lambda r: x * r[0] + y * r[1] + F.lit(float(r[2]))
    w = row(m[2])
    ok = F.abs(w) > 1e-12
    return F.when(ok, row(m[0]) / w), F.when(ok, row(m[1]) / w)


def _eighth(dx: Column, dy: Column) -> Column:
    return F.pmod(F.rint(F.atan2(dy, dx) / (math.pi / 4)), F.lit(8)).cast("int")


def compass(dx: Column, dy: Column) -> Column:
    """Name of the nearest of eight directions; ``stationary`` for no length."""
    return F.when(F.hypot(dx, dy) < 1e-6, "stationary").otherwise(F.get(F.array(*map(F.lit, COMPASS)), _eighth(dx, dy)))


def direction_bin(dx: Column, dy: Column, bins: int) -> Column:
    """Number of the direction bin; bins are centred on multiples of a full turn over ``bins``."""
    turn = 2 * math.pi
    angle = F.pmod(F.atan2(dy, dx), F.lit(turn))
    return F.pmod(F.floor((angle + math.pi / bins) / (turn / bins)), F.lit(bins)).cast("int")


def bin_name(number: Column, bins: int) -> Column:
    """Unhyphenated compass name of a direction bin."""
    return F.get(F.array(*[F.lit(c.replace("-", "")) for c in COMPASS]), F.pmod(F.rint(number * 8 / bins), F.lit(8)).cast("int"))


def cell_label(row: Column, col: Column) -> Column:
    return F.concat(F.lit("R"), (row + 1).cast("string"), F.lit("C"), (col + 1).cast("string"))


def label_centre(label: Column, grid_width: int, grid_height: int) -> Column:
    """struct(x, y) in 0..1 of a label's cell; null if it is no label."""
    pick = lambda k: F.nullif(F.regexp_extract(label, r"^R(\d+)C(\d+)$", k), F.lit("")).cast("int")
    return F.when(pick(1).isNotNull(), F.struct(((pick(2) - 0.5) / grid_width).alias("x"), ((pick(1) - 0.5) / grid_height).alias("y")))


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """True inside a polygon and on its edges."""
    edges = list(zip(points, [*points[1:], points[0]], strict=True))
    on, crossings = [], []
    for (ax, ay), (bx, by) in edges:
        cross = (F.lit(bx - ax) * (y - ay)) - (F.lit(by - ay) * (x - ax))
        on.append((F.abs(cross) <= 1e-9 * max(1.0, abs(bx - ax), abs(by - ay))) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            at = F.lit(ax) + (y - ay) * ((bx - ax) / (by - ay))
            crossings.append(F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at), 1).otherwise(0))
    odd = reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1
    return reduce(lambda a, b: a | b, on, odd)


def zone_at(x: Column, y: Column, zones: list[tuple[str, list[tuple[float, float]]]]) -> Column:
    """Id of the first zone in list order that holds the point; null outside all."""
    return F.coalesce(*[F.when(in_polygon(x, y, pts), F.lit(name)) for name, pts in zones], F.lit(None).cast("string"))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def edge_similarity(a: Column, b: Column) -> Column:
    """Share of b's elements that a has; one if b has none."""
    return F.when(F.size(b) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))


def band(y: Column, height: float, bands: int = 3) -> Column:
    return F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor(y * bands / F.lit(height)))).cast("int")


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return u * u * (3 - 2 * u)
