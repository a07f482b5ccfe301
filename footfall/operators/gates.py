"""Cells of zones, tracks that pass gates in order, and route signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.geometry import in_polygon


def zone_cells(spark: SparkSession, zones: list, width: float, height: float, columns: int, rows: int) -> DataFrame:
    """zone_id, row, col of the cells whose centre a zone's polygon (edges included) holds. As many rows as cells and zones: a dimension table."""
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("row"), F.pmod(F.col("id"), F.lit(columns)).cast("int").alias("col"))
    x, y = (F.col("col") + 0.5) * width / columns, (F.col("row") + 0.5) * height / rows
    held = F.filter(F.array(*[F.when(in_polygon(x, y, pts), F.lit(name)) for name, pts in zones]), lambda z: z.isNotNull())
    return cells.select(F.explode(held).alias("zone_id"), "row", "col")


def passed_in_order(steps: DataFrame, origins: DataFrame, goals: DataFrame, key: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Tracks (of steps with ``seq``, row, col) that were in an origin cell and later in a goal cell that is no origin.

    Cells are dimension tables (row, col), broadcast as they have a row a cell of the grid.
    """
    tagged = steps.join(F.broadcast(origins.select("row", "col", F.lit(True).alias("_s")).distinct()), ["row", "col"], "left").join(F.broadcast(goals.select("row", "col", F.lit(True).alias("_t")).distinct()), ["row", "col"], "left")
    first = F.min(F.when(F.col("_s"), F.col("seq")))
    last = F.max(F.when(F.col("_t") & F.col("_s").isNull(), F.col("seq")))
    return tagged.groupBy(*key).agg(first.alias("first_origin"), last.alias("last_goal")).filter("first_origin < last_goal")


def route_signature(cells: Column, scope: str) -> Column:
    """Scope and eight hexadecimal digits of the CRC-32 of a route (array of struct row, col) in its written form."""
    written = lambda c: F.concat(F.lit("("), c["row"].cast("string"), F.lit(", "), c["col"].cast("string"), F.lit(")"))
    route = F.concat(F.lit("("), F.array_join(F.transform(cells, written), ", "), F.when(F.size(cells) == 1, F.lit(",")).otherwise(F.lit("")), F.lit(")"))
    whole = F.concat(F.lit(f"('{scope}', "), written(F.get(cells, F.lit(0))), F.lit(", "), written(F.element_at(cells, -1)), F.lit(", "), route, F.lit(")"))
    return F.when(F.size(cells) > 0, F.concat(F.lit(f"{scope}-"), F.lower(F.lpad(F.hex(F.crc32(whole.cast("binary"))), 8, "0"))))
