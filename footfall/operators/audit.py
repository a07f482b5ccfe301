"""Checks and figures of whole runs: agreement, substantive changes, digests, performance, the best configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Samples of a stage that performance figures look back on.
SAMPLES = 2048
#: A path differs in substance from these on: confidence, and mean distance of the lines in pixels.
CONFIDENCE, PIXELS = 0.01, 5.0


def disagreements(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Frames on which two runs cannot be compared: in one run alone, or at different times.

    Both have frame_id and event_time_s, a row a frame. A run that skips a frame differs there, wherever its row stands.
    """
    x, y = a.select("frame_id", F.col("event_time_s").alias("a_time")), b.select("frame_id", F.col("event_time_s").alias("b_time"))
    j = x.withColumn("_a", F.lit(True)).join(y.withColumn("_b", F.lit(True)), "frame_id", "full_outer")
    apart = ~F.coalesce(F.abs(F.col("a_time") - F.col("b_time")) <= tolerance, F.lit(False))
    why = F.when(F.col("_b").isNull(), "ONLY_IN_A").when(F.col("_a").isNull(), "ONLY_IN_B").when(apart, "TIMESTAMP_DIFFERS")
    return j.withColumn("problem", why).filter("problem IS NOT NULL").select("frame_id", "a_time", "b_time", "problem")


def line_distance(a: Column, b: Column) -> Column:
    """Mean distance of two equally long lines (arrays of struct x, y), point by point; null for others and for empty ones."""
    far = F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(far, F.lit(0.0), lambda s, d: s + d) / F.size(a))


def path_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of two runs by frame and rank, and whether the second is another one in substance.

    Columns of both: frame_id, rank, path_id, direction, support_tracks, confidence, line. A path that one run alone
    shows is a change of substance.
    """
    cols = ["path_id", "direction", "support_tracks", "confidence", "line"]
    x, y = (d.select("frame_id", "rank", F.struct(*cols).alias(n)) for d, n in ((a, "a"), (b, "b")))
    j = x.join(y, ["frame_id", "rank"], "full_outer")
    named = ~(F.col("a.path_id").eqNullSafe(F.col("b.path_id")) & F.col("a.direction").eqNullSafe(F.col("b.direction")) & F.col("a.support_tracks").eqNullSafe(F.col("b.support_tracks")))
    sure = F.abs(F.coalesce("a.confidence", F.lit(0.0)) - F.coalesce("b.confidence", F.lit(0.0)))
    points = lambda n: F.greatest(F.size(F.col(f"{n}.line")), F.lit(0))
    away = line_distance(F.col("a.line"), F.col("b.line"))
    changed = F.col("a").isNull() | F.col("b").isNull() | named | (points("a") != points("b")) | (sure > CONFIDENCE) | F.coalesce(away > PIXELS, F.lit(False))
    return j.select("frame_id", "rank", F.col("a.path_id").alias("a_path"), F.col("b.path_id").alias("b_path"), F.round(sure, 6).alias("confidence_delta"), F.round(away, 6).alias("mean_distance"), changed.alias("substantive"))


def digest(*columns: str) -> Column:
    """SHA-256 of a row's named columns as JSON with sorted keys: the identity of a run or row by content."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def performance(samples: DataFrame, keep: int = SAMPLES) -> DataFrame:
    """Per stage (columns stage, timestamp, ms): median and 95th percentile of its last ``keep`` samples, and their rate a second."""
    last = Window.partitionBy("stage").orderBy(F.desc("timestamp"), F.desc("ms"))
    now = samples.filter("ms IS NOT NULL").withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= keep)
    span = F.max("timestamp") - F.min("timestamp")
    rate = F.when(span > 0, (F.count("*") - 1) / span).otherwise(F.lit(0.0))
    return now.groupBy("stage").agg(F.count("*").alias("samples"), F.round(F.percentile("ms", F.lit(0.5)), 3).alias("p50"), F.round(F.percentile("ms", F.lit(0.95)), 3).alias("p95"), F.round(rate, 3).alias("per_second"))


def counters(run: DataFrame) -> DataFrame:
    """Totals of a run from its frames (captured, processed, dropped, detector_images as counts a row) over ``elapsed`` seconds each."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    elapsed = F.greatest(n("elapsed"), F.lit(1e-6))
    per = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 3)
    return run.agg(
        n("captured").alias("source_frames"), n("processed").alias("processed_frames"), n("dropped").alias("dropped_frames"), F.round(n("captured") / elapsed, 3).alias("input_fps"), F.round(n("processed") / elapsed, 3).alias("processing_fps"),
        n("detector_images").alias("detector_images_total"), per(n("detector_images"), n("captured")).alias("detector_images_per_source_frame"), per(n("detector_images"), n("processed")).alias("detector_images_per_processed_frame"),
    )


def best_config(runs: DataFrame, floor: float) -> DataFrame:
    """The run (columns config, active_tracks, fps) with most active tracks, then most frames a second, of those at the floor or above; of all where none is."""
    ranked = runs.select("config", "active_tracks", "fps", (F.col("fps") >= floor).alias("ok"))
    best = ranked.agg(F.max(F.struct("ok", "active_tracks", "fps", "config")).alias("b"))
    return best.select("b.config", "b.active_tracks", "b.fps", F.col("b.ok").alias("at_floor")).filter("config IS NOT NULL")
