"""Crowd counts over frames, track life cycles and corpus figures.

``frames`` here are rows (camera_id, stream_epoch, frame, track_id, timestamp, x, y).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import Settings
from footfall.operators.steps import KEY, track_window


def per_frame(frames: DataFrame) -> DataFrame:
    return frames.groupBy("camera_id", "stream_epoch", "frame").agg(F.countDistinct("track_id").alias("people"))


def timeline(frames: DataFrame, s: Settings) -> DataFrame:
    """Mean and peak people per second."""
    return per_frame(frames).groupBy(F.floor(F.col("frame") / s.fps).alias("second")).agg(F.round(F.avg("people"), 3).alias("average"), F.max("people").alias("peak"))


def average_locf(frames: DataFrame, s: Settings) -> DataFrame:
    """Mean people weighted by how long each count stood, up to the gap bound."""
    w = Window.partitionBy("camera_id", "stream_epoch").orderBy("frame")
    t = per_frame(frames).withColumn("dt", (F.col("frame") - F.lag("frame").over(w)) / s.fps).withColumn("before", F.lag("people").over(w))
    t = t.filter("dt > 0").withColumn("w", F.least("dt", F.lit(s.max_point_gap_seconds)))
    return t.agg(F.round(F.sum(F.col("before") * F.col("w")) / F.sum("w"), 6).alias("average_people"))


def crowd_summary(frames: DataFrame) -> DataFrame:
    """Current, peak and distinct people, and frames."""
    f = per_frame(frames)
    a = f.agg(F.max_by("people", "frame").alias("current_people"), F.max("people").alias("peak_people"), F.count("*").alias("frames"))
    return a.crossJoin(F.broadcast(frames.agg(F.countDistinct(*KEY).alias("unique_tracks"))))


def unique_retained(points: DataFrame, seconds: float) -> DataFrame:
    """Distinct tracks seen within the last ``seconds``."""
    now = F.broadcast(points.agg(F.max("timestamp").alias("_now")))
    last = points.groupBy(*KEY).agg(F.max("timestamp").alias("last"))
    return last.crossJoin(now).filter(F.col("last") >= F.col("_now") - seconds).agg(F.count("*").alias("tracks"))


def corpus_validation(frames: DataFrame) -> DataFrame:
    """Points, tracks, frames, people per frame and bounds of a corpus."""
    f = per_frame(frames).agg(F.count("*").alias("frames"), F.round(F.avg("people"), 3).alias("average_people"), F.max("people").alias("max_people"), F.count(F.when(F.col("people") > 1, 1)).alias("overlapping_frames"))
    p = frames.agg(F.count("*").alias("points"), F.countDistinct(*KEY).alias("tracks"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return p.crossJoin(F.broadcast(f))


def lifecycle(points: DataFrame) -> DataFrame:
    """Points, first and last sight and path length of every track."""
    w = track_window()
    t = points.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return t.groupBy(*KEY).agg(F.count("*").alias("points"), F.round(F.min("timestamp"), 6).alias("first_seen"), F.round(F.max("timestamp"), 6).alias("last_seen"), F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 6).alias("path_length"))


def continuity(frames: DataFrame, expected: int) -> DataFrame:
    """Fragments (runs without a gap above ``expected`` frames), gaps and longest gap of every track."""
    w = Window.partitionBy(*KEY).orderBy("frame")
    t = frames.withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    return t.groupBy(*KEY).agg(F.count("*").alias("observed"), (F.count(F.when(F.col("gap") > expected, 1)) + 1).alias("fragments"), F.count(F.when(F.col("gap") == 1, 1)).alias("adjacent"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))


def validity(points: DataFrame, min_seconds: float, min_length: float, min_points: int, min_speed: float) -> DataFrame:
    """First reason that rules each track out, or ``VALID``."""
    t = lifecycle(points).withColumn("seconds", F.col("last_seen") - F.col("first_seen"))
    reason = (
        F.when(F.col("points") < min_points, "TOO_SHORT").when(F.col("seconds") < min_seconds, "SHORT_DURATION").when(F.col("path_length") < min_length, "LOW_DISPLACEMENT")
        .when(F.col("path_length") <= min_speed * F.col("seconds"), "STATIONARY").otherwise("VALID")
    )
    return t.groupBy(reason.alias("reason")).agg(F.count("*").alias("tracks"))


def cut_reasons(points: DataFrame, gap: float, jump: float) -> DataFrame:
    """Rows that do not continue their track: first sight, gap or jump."""
    w = track_window()
    t = points.withColumns({"dt": F.col("timestamp") - F.lag("timestamp").over(w), "d": F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))})
    reason = F.when(F.col("dt").isNull(), "RAW_ID_START").when(F.col("dt") > gap, "OBSERVATION_GAP").when(F.col("d") > jump, "JUMP_THRESHOLD")
    return t.withColumn("reason", reason).filter("reason is not null").select("track_id", "frame_id", "reason")


def active_intervals(frames: DataFrame, least: int, gap: int = 1) -> DataFrame:
    """Runs of frames with at least ``least`` people, frames up to ``gap`` apart."""
    on = per_frame(frames).filter(F.col("people") >= least)
    w = Window.partitionBy("camera_id", "stream_epoch").orderBy("frame")
    on = on.withColumn("_new", F.when(F.col("frame") - F.lag("frame").over(w) > gap, 1).otherwise(0)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return on.groupBy("camera_id", "stream_epoch", "run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames"), F.max("people").alias("peak")).drop("run")


def id_starts(frames: DataFrame, ever: bool = True) -> DataFrame:
    """Per frame: tracks that start (never seen before, or not in the frame before) and that vanish after it."""
    w = Window.partitionBy(*KEY).orderBy("frame")
    t = frames.withColumns({"_b": F.lag("frame").over(w), "_a": F.lead("frame").over(w)})
    start = F.col("_b").isNull() if ever else (F.col("_b").isNull() | (F.col("frame") - F.col("_b") > 1))
    gone = F.col("_a").isNull() | (F.col("_a") - F.col("frame") > 1)
    return t.groupBy("frame").agg(F.count("*").alias("tracks"), F.count(F.when(start, 1)).alias("started"), F.count(F.when(gone, 1)).alias("vanished"))


def stage_metrics(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivoted measurements: samples, mean, median, 95th percentile, maximum and sum per column; nulls are skipped."""
    long = frames.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "stage", "value").filter("value is not null")
    return long.groupBy("stage").agg(F.count("*").alias("samples"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.max("value").alias("top"), F.round(F.sum("value"), 6).alias("total"))


def nearest_rank(values: DataFrame, column: str, quantiles: tuple[float, ...] = (0.5, 0.95), ranges: int = 1000) -> DataFrame:
    """Percentiles by rank int((n - 1) * q) of the sorted values, counted in SQL rather than gathered.

    Approximate percentiles part the values in ranges; exact counts tell which range holds a rank, and only the values of
    those ranges (one for each quantile) are put in order.
    """
    v = values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    edges = v.agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges))).alias("edges"))
    placed = v.groupBy("v").agg(F.count("*").alias("c")).crossJoin(F.broadcast(edges)).select("v", "c", F.aggregate("edges", F.lit(0), lambda n, e: n + F.when(e < F.col("v"), 1).otherwise(0)).alias("part"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    parts = placed.groupBy("part").agg(F.sum("c").alias("in_part")).withColumns({"before": F.coalesce(F.sum("in_part").over(order), F.lit(0)), "n": F.sum("in_part").over(Window.partitionBy(F.lit(1)))})
    wanted = parts.select("part", "in_part", "before", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor((F.col("n") - 1) * q).alias("rank")) for k, q in enumerate(quantiles)])).alias("w")).select("part", "before", "n", "w.k", "w.rank", "in_part")
    wanted = wanted.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("in_part"))).drop("in_part")
    run = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(F.broadcast(wanted), "part").withColumn("upto", F.col("before") + F.sum("c").over(run)).filter(F.col("upto") > F.col("rank"))
    return near.agg(F.max("n").alias("samples"), *[F.min(F.when(F.col("k") == k, F.col("v"))).alias(f"p{int(q * 100)}") for k, q in enumerate(quantiles)])


def tumbling(frames: DataFrame, seconds: float, s: Settings) -> DataFrame:
    """Frames, span, rate and people per window of ``seconds``."""
    f = per_frame(frames).withColumn("window", F.floor(F.col("frame") / s.fps / seconds))
    return f.groupBy("window").agg(F.count("*").alias("frames"), (F.max("frame") - F.min("frame")).alias("span_frames"), F.round(F.avg("people"), 6).alias("average"), F.max("people").alias("peak"))


def band_counts(frames: DataFrame, height: float) -> DataFrame:
    """People per second in the upper, middle and lower third."""
    from footfall.functions.geometry import band

    b = frames.select(F.floor("timestamp").alias("second"), F.concat(F.lit("band"), band(F.col("y"), height).cast("string")).alias("b"))
    return b.groupBy("second").pivot("b", ["band0", "band1", "band2"]).count().fillna(0)
