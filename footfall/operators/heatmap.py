"""Occupancy and movement heatmaps as sparse (bucket, row, col) sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.operators.steps import fine_cell, is_move, steps

WINDOWS = {"current": "current_window_seconds", "1m": 60, "5m": "live_retention_seconds", "entire": None}


def occupancy(points: DataFrame, s: Settings) -> DataFrame:
    """Seconds spent per second bucket and cell; a gap counts up to the bound, and not at all past the track's lifetime."""
    st = steps(points).filter((F.col("dt") > 0) & (F.col("dt") <= s.inactive_track_ttl_seconds))
    cells = st.select(F.floor("timestamp").alias("bucket"), fine_cell(F.col("x"), F.col("y"), s).alias("c"), F.least("dt", F.lit(s.max_point_gap_seconds)).alias("w"))
    return cells.filter("c is not null").groupBy("bucket", "c.row", "c.col").agg(F.sum("w").alias("occupancy"))


def cell_line(a: Column, b: Column) -> Column:
    """Cells on the line between two cells, ends included (equal cells: twice)."""
    n = F.greatest(F.abs(b["row"] - a["row"]), F.abs(b["col"] - a["col"]), F.lit(1))
    at = lambda f, i: F.rint(a[f] + i * (b[f] - a[f]) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(at("row", i).alias("row"), at("col", i).alias("col")))


def movement(points: DataFrame, s: Settings) -> DataFrame:
    """Length moved per second bucket and cell, spread evenly over the cells of each step's line."""
    st = steps(points).filter(is_move(s)).select(F.floor("timestamp").alias("bucket"), "dist", fine_cell(F.col("px"), F.col("py"), s).alias("a"), fine_cell(F.col("x"), F.col("y"), s).alias("b"))
    line = st.filter("a is not null and b is not null").withColumn("line", cell_line(F.col("a"), F.col("b")))
    each = line.select("bucket", (F.col("dist") / F.size("line")).alias("w"), F.explode("line").alias("c"))
    return each.groupBy("bucket", "c.row", "c.col").agg(F.sum("w").alias("movement"))


def snapshot(buckets: DataFrame, value: str, latest: Column, window: str, s: Settings) -> DataFrame:
    """Sums per cell over the buckets that a named window holds; ``latest`` is the newest event time."""
    span = WINDOWS[window]
    seconds = getattr(s, span) if isinstance(span, str) else span
    kept = buckets if seconds is None else buckets.filter(F.col("bucket") >= F.floor(F.greatest(F.lit(0.0), latest - seconds)))
    return kept.groupBy("row", "col").agg(F.sum(value).alias(value))


def normalised(cells: DataFrame, value: str) -> DataFrame:
    """The value's share of the largest cell; one row of maxima, joined by broadcast."""
    top = cells.agg(F.max(value).alias("_top"))
    return cells.crossJoin(F.broadcast(top)).withColumn("share", F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.lit(0.0))).drop("_top")
