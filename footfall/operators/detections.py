"""Row filters and labels over detection boxes, scan schedules and decision counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from footfall.functions import polylines as L
from footfall.functions.geometry import box_iou

#: Share of a box that must be searched before its absence says something.
SEARCHED = 1 - 1e-6


def outside(boxes: DataFrame, regions: list[tuple[float, float, float, float]], width: float, height: float) -> DataFrame:
    """Boxes whose centre lies in none of the regions (given as shares of the picture)."""
    cx, cy = (F.col("x1") + F.col("x2")) / (2 * width), (F.col("y1") + F.col("y2")) / (2 * height)
    keep = F.lit(True)
    for x1, y1, x2, y2 in regions:
        keep = keep & ~(cx.between(x1, x2) & cy.between(y1, y2))
    return boxes.filter(keep)


def tiles(length: int, count: int, overlap: float) -> list[tuple[int, int]]:
    """Starts and ends of equally long tiles over a length, neighbours overlapping by a share of a tile."""
    if count < 2:
        return [(0, length)]
    size = min(length, math.ceil(length / (count - (count - 1) * overlap)))
    return [(round(k * (length - size) / (count - 1)), round(k * (length - size) / (count - 1)) + size) for k in range(count)]


def off_tile_edges(boxes: DataFrame, spans: list[tuple[int, int]], length: int, least: float, reach: float = 2.0) -> DataFrame:
    """Boxes less the weak ones that touch an inner edge of their tile (column ``tile`` numbers the spans)."""
    touch = F.lit(False)
    for k, (a, b) in enumerate(spans):
        left = (F.col("x1") <= a + reach) if a > 0 else F.lit(False)
        right = (F.col("x2") >= b - reach) if b < length else F.lit(False)
        touch = touch | ((F.col("tile") == k) & (left | right))
    return boxes.filter(~(touch & (F.col("confidence") < least)))


def confidence_band(high: float, low: float) -> Column:
    """Boxes that may start a track, boxes that may only continue one, and the rest."""
    return F.when(F.col("confidence") >= high, "high").when(F.col("confidence") >= low, "low").otherwise("dropped")


@F.pandas_udf(DoubleType())
def covered_share(box: pd.DataFrame, regions: pd.Series) -> pd.Series:
    """Share of each box (struct x1, y1, x2, y2) that its searched regions (array of such structs) cover."""
    rects = [[(r["x1"], r["y1"], r["x2"], r["y2"]) for r in (rs if rs is not None else [])] for rs in regions]
    return pd.Series([L.covered(b, r) for b, r in zip(box[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None), rects, strict=True)])


def coverage_state(observed: Column, skipped: Column, share: Column) -> Column:
    """What is known of a track in a frame: measured, looked for in vain, or not looked for."""
    return F.when(observed, "MEASURED").when(skipped | (share < SEARCHED), "NOT_SEARCHED_BY_POLICY").otherwise("SEARCHED_NOT_FOUND")


def scan_schedule(frames: DataFrame, every: int) -> DataFrame:
    """Frames of each camera session that a deadline schedule scans, and whether the deadline was missed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for frame in sorted(pdf.frame):
            gap = None if last is None else frame - last
            if gap is None or gap >= every:
                out.append((pdf.camera_id.iat[0], pdf.stream_epoch.iat[0], frame, gap is not None and gap > every))
                last = frame
        return pd.DataFrame(out, columns=["camera_id", "stream_epoch", "frame", "missed"])

    return frames.select("camera_id", "stream_epoch", "frame").distinct().groupBy("camera_id", "stream_epoch").applyInPandas(run, "camera_id string, stream_epoch string, frame long, missed boolean")


def funnel(decisions: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows and tracks by decision, with their share of all rows."""
    n = decisions.groupBy(reason).agg(F.count("*").alias("rows"), F.countDistinct("track_id").alias("tracks"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("rows").alias("_all")))).withColumn("share", F.round(F.col("rows") / F.col("_all"), 6)).drop("_all")


def switches(timeline: DataFrame, key: tuple[str, ...] = ("camera_id", "stream_epoch")) -> DataFrame:
    """Changes of the shown path (column path_id by timestamp) per minute, and when one was first shown."""
    w = Window.partitionBy(*key).orderBy("timestamp")
    t = timeline.withColumn("_before", F.lag("path_id").over(w))
    changed = F.count(F.when(F.col("_before").isNotNull() & (F.col("_before") != F.col("path_id")), 1))
    minutes = F.greatest((F.max("timestamp") - F.min("timestamp")) / 60, F.lit(1 / 60))
    return t.groupBy(*key).agg(F.min("timestamp").alias("first_active"), changed.alias("switches"), F.round(changed / minutes, 6).alias("per_minute"))


def adjacent_overlap(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """Of the tracks seen in two frames running, those whose boxes overlap enough: the share that keeps its place."""
    a = boxes.select("frame", "track_id", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = boxes.select((F.col("frame") - 1).alias("frame"), "track_id", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    iou = box_iou([F.col(f"a_{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = a.join(b, ["frame", "track_id"]).withColumn("iou", iou)
    return j.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("iou") >= least, 1)).alias("overlapping"), F.round(F.avg("iou"), 6).alias("mean_overlap"))
