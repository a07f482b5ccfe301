import pytest
from pyspark.sql import functions as F

from footfall.operators import detections as D


def test_tiles_cover_and_overlap():
    assert D.tiles(100, 1, 0.2) == [(0, 100)]
    got = D.tiles(1000, 3, 0.2)
    assert got[0][0] == 0 and got[-1][1] == 1000 and all(a[1] > b[0] for a, b in zip(got, got[1:]))


def test_weak_boxes_at_inner_edges_go(spark):
    rows = [(0, 399.0, 400.0, 0.2), (0, 399.0, 400.0, 0.9), (0, 0.0, 20.0, 0.2), (1, 320.0, 350.0, 0.2), (1, 500.0, 700.0, 0.2)]
    df = spark.createDataFrame(rows, "tile int, x1 double, x2 double, confidence double")
    assert D.off_tile_edges(df, [(0, 400), (320, 720)], 720, 0.5).count() == 3


def test_coverage_states(spark):
    rows = [(True, False, 0.0), (False, True, 1.0), (False, False, 0.5), (False, False, 1.0)]
    df = spark.createDataFrame(rows, "o boolean, s boolean, c double").select(D.coverage_state(F.col("o"), F.col("s"), F.col("c")).alias("v"))
    assert [r.v for r in df.collect()] == ["MEASURED", "NOT_SEARCHED_BY_POLICY", "NOT_SEARCHED_BY_POLICY", "SEARCHED_NOT_FOUND"]
    box = "struct<x1: double, y1: double, x2: double, y2: double>"
    b = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), [(0.0, 0.0, 1.0, 2.0)]), ((0.0, 0.0, 2.0, 2.0), None)], f"b {box}, r array<{box}>")
    assert [r.v for r in b.select(D.covered_share("b", "r").alias("v")).collect()] == pytest.approx([0.5, 0.0])


def test_schedule_meets_and_misses_deadlines(spark):
    df = spark.createDataFrame([("c", "e", f) for f in (0, 1, 2, 3, 4, 9, 10)], "camera_id string, stream_epoch string, frame long")
    assert sorted((r.frame, r.missed) for r in D.scan_schedule(df, 3).collect()) == [(0, False), (3, False), (9, True)]
