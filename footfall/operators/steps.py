"""Each point with the one before it on the same track: the base of heat, flow and route operators.

Tracks belong to one camera session, so a window over (camera, epoch, track) is bounded by
the session's length; the shuffle is on these three columns, and operators chained on the result reuse it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import Settings
from footfall.functions.geometry import grid_cell

KEY = ("camera_id", "stream_epoch", "track_id")


def track_window(*order: str) -> Window:
    return Window.partitionBy(*KEY).orderBy(*(order or ("timestamp", "frame_id")))


def steps(points: DataFrame) -> DataFrame:
    """Points with ``dt``, ``dx``, ``dy``, ``dist`` and the point before (``px``, ``py``, ``pt``)."""
    w = track_window()
    out = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "pt": F.lag("timestamp").over(w)})
    out = out.withColumns({"dt": F.col("timestamp") - F.col("pt"), "dx": F.col("x") - F.col("px"), "dy": F.col("y") - F.col("py")})
    return out.withColumn("dist", F.hypot("dx", "dy"))


def is_move(s: Settings) -> Column:
    """The movement gate: a positive gap within bounds, a length within bounds (both ends included)."""
    return (F.col("dt") > 0) & (F.col("dt") <= s.max_point_gap_seconds) & F.col("dist").between(s.movement_threshold, s.max_movement_step)


def fine_cell(x: Column, y: Column, s: Settings) -> Column:
    return grid_cell(x, y, s.width, s.height, s.grid_width, s.grid_height)


def macro_cell(x: Column, y: Column, s: Settings) -> Column:
    return grid_cell(x, y, s.width, s.height, s.path_grid_width, s.path_grid_height)


def eligible(points: DataFrame, s: Settings) -> DataFrame:
    """Points of tracks with enough points."""
    enough = points.groupBy(*KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") >= s.min_confirmed_points).drop("_n")
    return points.join(enough, list(KEY), "left_semi")


def gap_segments(points: DataFrame, gap: float) -> DataFrame:
    """Points with ``segment``: the running number of gaps longer than ``gap`` on the track."""
    w = track_window()
    new = F.when(F.col("timestamp") - F.lag("timestamp").over(w) > gap, 1).otherwise(0)
    return points.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")
