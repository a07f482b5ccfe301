"""The driver's event table as a trajectory point stream.

A user is a track, an event a frame. Thirty days become 72 seconds (one second is 36e9
microseconds of the table), x is the event's value up to the plane's width and y the number in its
properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US, US_PER_SECOND = 1704067200000000, 36_000_000_000
#: Zones by rank: polygons of the 200 x 100 plane; the upper right corner is outside all.
ZONES = [
    ("a", [(0.0, 0.0), (40.0, 0.0), (40.0, 100.0), (0.0, 100.0)]),
    ("b", [(40.0, 0.0), (100.0, 0.0), (100.0, 100.0), (40.0, 100.0)]),
    ("c", [(100.0, 0.0), (200.0, 0.0), (200.0, 80.0), (100.0, 80.0)]),
]


def points(spark: SparkSession, sf_dir: str, width: float = 200.0) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value", "props")
    return e.select(
        F.lit("cam01").alias("camera_id"),
        F.lit("e0").alias("stream_epoch"),
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("frame_id"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(float(US_PER_SECOND))).alias("timestamp"),
        F.least(F.col("value"), F.lit(width)).alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.lit(1.0).alias("confidence"),
    )


def frames(points: DataFrame, fps: float = 25.0) -> DataFrame:
    """The last point of each track in each frame of a regular clock: frame number ``frame``, and the points' columns."""
    f = points.withColumn("frame", F.floor(F.col("timestamp") * fps))
    last = f.groupBy("camera_id", "stream_epoch", "frame", "track_id").agg(F.max(F.struct("frame_id", "timestamp", "x", "y", "confidence")).alias("p"))
    return last.select("camera_id", "stream_epoch", "frame", "track_id", "p.*")


def boxes(frame_points: DataFrame, width: float = 12.0, height: float = 24.0, shift: float = 0.0) -> DataFrame:
    """Boxes whose bottom centres are the points."""
    x = F.col("x") + shift
    return frame_points.select("frame", "track_id", "confidence", (x - width / 2).alias("x1"), (F.col("y") - height).alias("y1"), (x + width / 2).alias("x2"), F.col("y").alias("y2"))
