"""Zone membership, visits, dwell and origin-destination flows by gaps and islands.

These are the forms without debounce (a point is enough to change zone). The debounced
state machine is in ``kernels.zone_states``; both count alike for a debounce of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import Settings
from footfall.functions.geometry import zone_at
from footfall.operators.steps import KEY, track_window


def tagged(points: DataFrame, zones: list) -> DataFrame:
    """Points with ``zone_id`` of the first zone in list order that holds them."""
    return points.withColumn("zone_id", zone_at(F.col("x"), F.col("y"), zones))


def changes(points: DataFrame, zones: list, s: Settings) -> DataFrame:
    """Every change of zone: (track, stay, timestamp, left, entered); outside is null.

    A track idle for longer than its lifetime leaves at its last sight and starts a new stay.
    """
    w = track_window()
    t = tagged(points, zones)
    gap = F.col("timestamp") - F.lag("timestamp").over(w)
    t = t.withColumn("_new", F.when(gap.isNull() | (gap > s.inactive_track_ttl_seconds), 1).otherwise(0)).withColumn("stay", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*KEY, "stay").orderBy("timestamp", "frame_id")
    t = t.withColumn("_before", F.lag("zone_id").over(inside))
    moved = t.filter(~F.col("zone_id").eqNullSafe(F.col("_before"))).select(*KEY, "stay", "timestamp", "frame_id", F.col("_before").alias("left"), F.col("zone_id").alias("entered"))
    now = F.broadcast(points.agg(F.max("timestamp").alias("_now")))
    last = t.groupBy(*KEY, "stay").agg(F.max(F.struct("timestamp", "frame_id", "zone_id")).alias("p"))
    end = Window.partitionBy(*KEY).orderBy(F.desc("stay"))
    last = last.withColumn("_rank", F.row_number().over(end)).crossJoin(now).filter((F.col("_rank") > 1) | (F.col("_now") - F.col("p.timestamp") > s.inactive_track_ttl_seconds))
    gone = last.filter("p.zone_id is not null").select(*KEY, "stay", "p.timestamp", "p.frame_id", F.col("p.zone_id").alias("left"), F.lit(None).cast("string").alias("entered"))
    return moved.unionByName(gone.withColumn("gone", F.lit(1)), allowMissingColumns=True).withColumn("gone", F.coalesce("gone", F.lit(0)))


def transitions(found: DataFrame) -> DataFrame:
    """Entries and exits of each zone."""
    e = found.filter("entered is not null").select(F.col("entered").alias("zone_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    x = found.filter("left is not null").select(F.col("left").alias("zone_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    return e.unionByName(x).groupBy("zone_id").agg(F.sum("i").alias("entries"), F.sum("o").alias("exits"))


def dwell(found: DataFrame) -> DataFrame:
    """Completed visits of each zone and their mean length in seconds."""
    order = Window.partitionBy(*KEY, "stay").orderBy("timestamp", "frame_id", "gone")
    v = found.withColumn("_since", F.lag("timestamp").over(order)).filter("left is not null")
    return v.groupBy(F.col("left").alias("zone_id")).agg(F.count("*").alias("visits"), F.round(F.avg(F.greatest(F.lit(0.0), F.col("timestamp") - F.col("_since"))), 3).alias("average_dwell"))


def od_flows(found: DataFrame) -> DataFrame:
    """Distinct tracks per ordered pair of zones entered one after the other, outside not counted between."""
    order = Window.partitionBy(*KEY, "stay").orderBy("timestamp", "frame_id")
    v = found.filter("entered is not null").withColumn("_from", F.lag("entered").over(order)).filter(F.col("_from") != F.col("entered"))
    return v.select(*KEY, F.col("_from").alias("from_zone"), F.col("entered").alias("to_zone")).distinct().groupBy("from_zone", "to_zone").agg(F.count("*").alias("tracks"))


def first_last_flow(points: DataFrame, zones: list, s: Settings) -> DataFrame:
    """Confirmed tracks by first and last zone, where these differ."""
    t = tagged(points, zones)
    order = F.struct("timestamp", "frame_id")
    ends = t.groupBy(*KEY).agg(F.count("*").alias("n"), F.min_by("zone_id", F.when(F.col("zone_id").isNotNull(), order)).alias("first_zone"), F.max_by("zone_id", F.when(F.col("zone_id").isNotNull(), order)).alias("last_zone"))
    return ends.filter((F.col("n") >= s.min_confirmed_points) & (F.col("first_zone") != F.col("last_zone"))).groupBy("first_zone", "last_zone").agg(F.count("*").alias("tracks"))
