"""Direction fields, macro-cell edges and popular routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import Settings
from footfall.functions.geometry import cell_label, compass, direction_bin
from footfall.operators.steps import KEY, fine_cell, is_move, macro_cell, steps


def direction_field(points: DataFrame, s: Settings) -> DataFrame:
    """Per second bucket and cell of the step's midpoint: summed vector and steps."""
    st = steps(points).filter(is_move(s)).select(F.floor("timestamp").alias("bucket"), "dx", "dy", fine_cell((F.col("px") + F.col("x")) / 2, (F.col("py") + F.col("y")) / 2, s).alias("c"))
    return st.filter("c is not null").groupBy("bucket", "c.row", "c.col").agg(F.sum("dx").alias("vx"), F.sum("dy").alias("vy"), F.count("*").alias("samples"))


def dominant_direction(field: DataFrame) -> DataFrame:
    """One row: the summed vector and its compass name."""
    return field.agg(F.coalesce(F.sum("vx"), F.lit(0.0)).alias("vx"), F.coalesce(F.sum("vy"), F.lit(0.0)).alias("vy"), F.coalesce(F.sum("samples"), F.lit(0)).alias("samples")).withColumn("direction", compass(F.col("vx"), F.col("vy")))


def macro_moves(points: DataFrame, s: Settings) -> DataFrame:
    """Steps that pass the gate and change the macro cell: from (a) and to (b)."""
    st = steps(points).filter(is_move(s)).withColumns({"a": macro_cell(F.col("px"), F.col("py"), s), "b": macro_cell(F.col("x"), F.col("y"), s)})
    return st.filter("a is not null and b is not null and a <> b")


def macro_edges(points: DataFrame, s: Settings) -> DataFrame:
    """Changes of macro cell per second bucket and directed edge."""
    m = macro_moves(points, s)
    return m.groupBy(F.floor("timestamp").alias("bucket"), F.col("a.row").alias("from_row"), F.col("a.col").alias("from_col"), F.col("b.row").alias("to_row"), F.col("b.col").alias("to_col")).agg(F.count("*").alias("n"))


def routes(points: DataFrame, s: Settings) -> DataFrame:
    """One row per track and stay: its consecutive distinct macro cells.

    A stay ends when the track is idle for longer than its lifetime. The first cell is the first
    observed one; later ones come from steps that pass the gate; beyond the bound the last is overwritten.
    """
    st = steps(points).withColumns({"a": macro_cell(F.col("px"), F.col("py"), s), "b": macro_cell(F.col("x"), F.col("y"), s)})
    order = Window.partitionBy(*KEY).orderBy("timestamp", "frame_id")
    idle = F.when(F.col("dt").isNull() | (F.col("dt") > s.inactive_track_ttl_seconds), 1).otherwise(0)
    st = st.withColumn("_first", idle).withColumn("stay", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    moved = F.coalesce(is_move(s) & (F.col("a") != F.col("b")), F.lit(False))
    st = st.filter(F.col("b").isNotNull() & ((F.col("_first") == 1) | moved))
    inside = Window.partitionBy(*KEY, "stay").orderBy("timestamp", "frame_id")
    st = st.withColumn("_before", F.lag("b").over(inside)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("b")))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "frame_id", "b"))), lambda p: cell_label(p["b"]["row"], p["b"]["col"]))
    out = st.groupBy(*KEY, "stay").agg(cells.alias("cells")).filter(F.size("cells") > 1)
    top = s.max_route_cells
    return out.withColumn("cells", F.when(F.size("cells") <= top, F.col("cells")).otherwise(F.concat(F.slice("cells", 1, top - 1), F.slice("cells", -1, 1))))


def route_counts(found: DataFrame) -> DataFrame:
    """Each route with how often it was walked and its percentage of all walks."""
    counts = found.groupBy(F.array_join("cells", " -> ").alias("label")).agg(F.count("*").alias("walks"))
    total = counts.agg(F.sum("walks").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percentage", F.round(F.col("walks") * 100.0 / F.col("_all"), 2)).drop("_all")


def top_routes(found: DataFrame, limit: int = 5) -> DataFrame:
    return route_counts(found).orderBy(F.desc("walks"), "label").limit(limit)


def direction_histogram(points: DataFrame, s: Settings, bins: int, short: float, long: float) -> DataFrame:
    """Per cell and direction bin: distinct tracks last seen there within the short and the long window."""
    st = steps(points).filter(is_move(s)).select(*KEY, "timestamp", fine_cell(F.col("x"), F.col("y"), s).alias("c"), direction_bin(F.col("dx"), F.col("dy"), bins).alias("bin")).filter("c is not null")
    seen = st.groupBy("c.row", "c.col", "bin", *KEY).agg(F.max("timestamp").alias("last"))
    now = F.broadcast(points.agg(F.max("timestamp").alias("_now")))
    age = F.col("_now") - F.col("last")
    return seen.crossJoin(now).groupBy("row", "col", "bin").agg(F.count(F.when(age <= short, 1)).alias("short_tracks"), F.count(F.when(age <= long, 1)).alias("long_tracks")).filter("long_tracks > 0")


def dominant_vote(points: DataFrame, s: Settings, bins: int, least: int) -> DataFrame:
    """The direction with most distinct tracks among those with enough of them; the lowest bin on a tie."""
    st = steps(points).filter(is_move(s)).select(*KEY, direction_bin(F.col("dx"), F.col("dy"), bins).alias("bin"))
    return st.groupBy("bin").agg(F.countDistinct(*KEY).alias("tracks")).filter(F.col("tracks") >= least).orderBy(F.desc("tracks"), "bin").limit(1)


def edge_last_seen(points: DataFrame, s: Settings) -> DataFrame:
    m = macro_moves(points, s)
    return m.groupBy(F.col("a.row").alias("from_row"), F.col("a.col").alias("from_col"), F.col("b.row").alias("to_row"), F.col("b.col").alias("to_col"), *KEY).agg(F.max("timestamp").alias("last"))


def directed_flow(points: DataFrame, s: Settings, short: float, long: float) -> DataFrame:
    """Edges with distinct tracks of both windows and their rate-weighted score."""
    span = F.broadcast(points.agg(F.max("timestamp").alias("_now"), F.min("timestamp").alias("_start")))
    age = F.col("_now") - F.col("last")
    e = edge_last_seen(points, s).crossJoin(span).groupBy("from_row", "from_col", "to_row", "to_col", "_now", "_start").agg(F.count(F.when(age <= short, 1)).alias("short_tracks"), F.count(F.when(age <= long, 1)).alias("long_tracks"))
    alive = F.greatest(F.lit(1.0), F.col("_now") - F.col("_start"))
    score = 0.65 * F.col("short_tracks") / F.least(F.lit(float(short)), alive) + 0.35 * F.col("long_tracks") / F.least(F.lit(float(long)), alive)
    return e.filter("long_tracks > 0").withColumn("score", F.round(score, 6)).drop("_now", "_start")


def decayed_edges(points: DataFrame, s: Settings, bucket: float, short: float, long: float, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Edges scored by distinct tracks per bucket, decayed over two windows and scaled by the largest."""
    m = macro_moves(points, s).withColumn("b_no", F.floor(F.col("timestamp") / bucket))
    keys = [F.col("a.row").alias("from_row"), F.col("a.col").alias("from_col"), F.col("b.row").alias("to_row"), F.col("b.col").alias("to_col")]
    names = ["from_row", "from_col", "to_row", "to_col"]
    m = m.select(*keys, "b_no", *KEY).distinct()
    now = F.broadcast(points.agg(F.max("timestamp").alias("_now")))
    end = (F.col("b_no") + 1) * bucket
    age = F.greatest(F.lit(0.0), F.col("_now") - end)
    m = m.crossJoin(now).filter(end > F.col("_now") - long)
    wl, ws = F.exp(-age / long), F.when(end > F.col("_now") - short, F.exp(-age / short)).otherwise(F.lit(0.0))
    e = m.withColumns({"wl": wl, "ws": ws, "is_short": end > F.col("_now") - short}).groupBy(*names).agg(
        F.sum("wl").alias("wl"), F.sum("ws").alias("ws"), F.countDistinct("track_id").alias("long_tracks"), F.countDistinct(F.when(F.col("is_short"), F.col("track_id"))).alias("short_tracks")
    )
    top = F.broadcast(e.agg(F.max("wl").alias("_l"), F.max("ws").alias("_s")))
    share = lambda v, t: F.when(F.col(t) > 0, F.col(v) / F.col(t)).otherwise(F.lit(0.0))
    a, b = weights
    return e.crossJoin(top).withColumn("score", F.round((a * share("ws", "_s") + b * share("wl", "_l")) / (a + b), 6)).select(*names, "short_tracks", "long_tracks", "score")


def top_od_pairs(found: DataFrame, least: int = 1, limit: int = 10) -> DataFrame:
    """Route ends with most distinct tracks."""
    od = found.select(*KEY, F.element_at("cells", 1).alias("origin"), F.element_at("cells", -1).alias("destination"))
    return od.groupBy("origin", "destination").agg(F.countDistinct(*KEY).alias("tracks")).filter(F.col("tracks") >= least).orderBy(F.desc("tracks"), "origin", "destination").limit(limit)
