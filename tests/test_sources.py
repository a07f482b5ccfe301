import json

import pytest
from pyspark.sql import functions as F

from footfall.sources import readers as R

ZONES = [("a", [(0, 0), (45, 0), (45, 100), (0, 100)]), ("b", [(55, 0), (100, 0), (100, 100), (55, 100)])]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "000001.txt").write_text("10 20 0 20 20 20 30 20 60\n")
    (tmp_path / "000002.txt").write_text("90 50 0\n70 50 20 40 50 40")
    return tmp_path


def test_annotations(spark, folder):
    rows = R.read_annotations(spark, str(folder))
    assert [(r.pedestrian_id, r.frame_id, r.x, r.y) for r in rows.orderBy("pedestrian_id", "frame_id").collect()] == [(1, 0, 10, 20), (1, 20, 20, 20), (1, 60, 30, 20), (2, 0, 90, 50), (2, 20, 70, 50), (2, 40, 40, 50)]
    assert R.read_annotations(spark, str(folder), 0.8).count() == 4
    p = R.annotation_points(rows, [[1, 0, 2], [0, 1, 3], [0, 0, 1]], ZONES).orderBy("track_id", "frame_id").collect()
    assert [r.track_id for r in p] == [100, 100, 101, 200, 200, 200] and (p[0].world_x, p[0].world_y, p[0].zone_id) == (12.0, 23.0, "a") and p[1].timestamp == 0.8
    assert [c.split()[0] for c in R.POINTS.split(", ")] == R.annotation_points(rows).columns


@pytest.mark.parametrize(("name", "text"), [("3.txt", "1 2"), ("x.txt", "1 2 3"), ("3.txt", "1 2 x"), ("3.txt", "1 2 5 1 2 4"), ("3.txt", "1 2 0.5"), ("3.txt", "NaN 2 1")])
def test_bad_annotations_stop_the_read(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match="name is no number|triples|bad value|backwards"):
        R.read_annotations(spark, str(tmp_path)).collect()


def test_file_order(spark):
    df = spark.createDataFrame([("10.txt",), ("9.txt",), ("notes.txt",)], "f string")
    assert [r.f for r in df.orderBy(R.numeric_stem(F.col("f")), "f").collect()] == ["9.txt", "10.txt", "notes.txt"]


def test_points_round_trip_with_pushdown(spark, folder, tmp_path):
    p = R.annotation_points(R.read_annotations(spark, str(folder)))
    report = R.write_points(p, str(tmp_path / "p"), str(tmp_path / "c")).first()
    assert (report.rows, report.tracks, report.frames) == (6, 3, 4)
    back = R.read_points(spark, str(tmp_path / "p"), "ground_truth", 1.0)
    assert back.count() == 4 and R.only_source(back) == "ground_truth"
    plan = back._jdf.queryExecution().executedPlan().treeString()
    assert "PushedFilters" in plan and "EqualTo(source,ground_truth)" in plan
    assert R.read_points_csv(spark, str(tmp_path / "c")).count() == 6 and R.track_lifetimes(back).count() == 2
    with pytest.raises(ValueError, match="no points"):
        R.write_points(p.limit(0), str(tmp_path / "q"))
    with pytest.raises(ValueError, match="mix"):
        R.only_source(p.unionByName(p.withColumn("source", F.lit("prediction"))))


def test_frame_cache(spark, tmp_path):
    rows = [{"frame_id": 0, "event_time_s": 0.0, "detections": [{"x1": 0, "y1": 0, "x2": 5, "y2": 5, "confidence": 0.5}], "tracks": [{"track_id": 4, "x1": 0, "y1": 0, "x2": 5, "y2": 5}]}, {"frame_id": 3, "source_timestamp": 0.12, "detections": [], "tracks": []}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    c = R.read_frame_cache(spark, str(tmp_path / "c.jsonl"))
    assert [r.event_time_s for r in c.orderBy("frame_id").collect()] == [0.0, 0.12] and R.cache_order_errors(c).count() == 0
    t = R.cache_tracks(c).first()
    assert t.observed is True and t.confidence == 0.0 and R.cache_detections(c).first().class_id == 0
    frames = spark.createDataFrame([(0, 0.0), (3, 0.5), (4, 0.6)], "frame_id long, timestamp double")
    assert [r.problem for r in R.aligned(frames, c).orderBy("frame_id").collect()] == [None, "TIME_MISMATCH", "FRAME_MISSING"]


def test_zones_homography_and_perspective(spark, tmp_path):
    (tmp_path / "z.json").write_text(json.dumps({"image_width": 100, "image_height": 100, "zones": [{"id": "a", "name": "A", "points": [[0, 0], [50, 0], [50, 100]]}, {"zone_id": "b", "points": [[60, 0], [90, 0], [90, 50]]}]}))
    assert R.read_zones(spark, str(tmp_path / "z.json"), 200, 50) == [("a", [(0, 0), (100, 0), (100, 50)]), ("b", [(120, 0), (180, 0), (180, 25)])]
    (tmp_path / "h.json").write_text('{"homog":[[1,0,2],[0,1,3],[0,0,1]]}')
    assert R.read_homography(spark, str(tmp_path / "h.json"))[0] == [1, 0, 2]
    (tmp_path / "h.json").write_text("[[1,0,0],[2,0,0],[0,0,1]]")
    with pytest.raises(ValueError):
        R.read_homography(spark, str(tmp_path / "h.json"))
    m = R.perspective([(0, 0), (10, 0), (10, 10), (0, 10)], 8, 4)
    from footfall.functions.geometry import project

    x, y = project(F.lit(10.0), F.lit(10.0), m)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(8), pytest.approx(4))
    with pytest.raises(ValueError):
        R.perspective([(0, 0), (1, 1), (2, 2), (3, 3)], 8, 4)


def test_packets(spark):
    head = json.dumps({"frame_id": 7, "event_time_s": 1.5}).encode()
    good = len(head).to_bytes(4, "big") + head + b"JPEG"
    df = spark.createDataFrame([(bytearray(good),), (bytearray(b"\0\0"),), (bytearray((1 << 30).to_bytes(4, "big") + b"x"),)], "packet binary")
    rows = R.unpack_packets(df).collect()
    assert rows[0].header.frame_id == 7 and bytes(rows[0].body) == b"JPEG" and [r.problem for r in rows] == [None, "BAD_PACKET", "BAD_PACKET"]


def test_changes_only(spark):
    rows = [("c", "e", t, s) for t, s in [(0.0, "a"), (0.2, "a"), (0.4, "b"), (0.6, "b"), (1.1, "b")]]
    df = spark.createDataFrame(rows, "camera_id string, stream_epoch string, timestamp double, state string")
    assert [r.timestamp for r in R.changed_rows(df, ["state"]).orderBy("timestamp").collect()] == [0.0, 0.4, 1.1]
