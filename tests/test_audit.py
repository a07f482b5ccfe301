import math
import zlib

import pytest
from pyspark.sql import functions as F

from footfall.config import Settings, flatten
from footfall.functions import engines as E
from footfall.functions import tracks as K
from footfall.operators import audit, gates, stateful, summary
from footfall.sources import readers as R


def test_runs_agree_by_frame_and_time(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 0.1), (3, 0.2)], "frame_id long, event_time_s double")
    b = spark.createDataFrame([(1, 0.0), (2, 0.1 + 2e-6), (4, 0.3), (5, None)], "frame_id long, event_time_s double")
    got = {(r.frame_id, r.problem) for r in audit.disagreements(a, b).collect()}
    assert got == {(2, "TIMESTAMP_DIFFERS"), (3, "ONLY_IN_A"), (4, "ONLY_IN_B"), (5, "ONLY_IN_B")}
    assert audit.disagreements(a, a).count() == 0


def test_a_change_of_path_is_substantive(spark):
    line = [(0.0, 0.0), (10.0, 0.0)]
    base = (1, "p", "east", 4, 0.5, line)
    others = {
        1: (1, "p", "east", 4, 0.509, [(0.0, 5.0), (10.0, 5.0)]), 2: (1, "q", "east", 4, 0.5, line), 3: (1, "p", "east", 5, 0.5, line), 4: (1, "p", "east", 4, 0.52, line),
        5: (1, "p", "east", 4, 0.5, [*line, (20.0, 0.0)]), 6: (1, "p", "east", 4, 0.5, [(0.0, 6.0), (10.0, 6.0)]), 7: (2, "p", "east", 4, 0.5, line), 8: (1, "p", "east", 4, 0.5, None),
    }
    kind = "frame_id long, rank int, path_id string, direction string, support_tracks int, confidence double, line array<struct<x: double, y: double>>"
    a = spark.createDataFrame([(k, *base) for k in others], kind)
    b = spark.createDataFrame([(k, *o) for k, o in others.items()], kind)
    got = {(r.frame_id, r["rank"]): r.substantive for r in audit.path_changes(a, b).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 1): True, (4, 1): True, (5, 1): True, (6, 1): True, (7, 1): True, (7, 2): True, (8, 1): True}


def test_performance_looks_at_the_last_samples(spark):
    rows = [("track", float(k), float(k % 100)) for k in range(3000)] + [("draw", 1.0, 5.0), ("idle", 2.0, None)]
    got = {r.stage: r for r in audit.performance(spark.createDataFrame(rows, "stage string, timestamp double, ms double")).collect()}
    assert set(got) == {"track", "draw"} and got["track"].samples == 2048 and got["track"].per_second == 1.0
    assert (got["draw"].p50, got["draw"].per_second) == (5.0, 0.0)
    run = spark.createDataFrame([(10, 8, 2, 16, 1.0), (10, 10, 0, 20, 1.0)], "captured int, processed int, dropped int, detector_images int, elapsed double")
    c = audit.counters(run).first()
    assert (c.source_frames, c.processing_fps, c.detector_images_per_source_frame, c.detector_images_per_processed_frame) == (20, 9.0, 1.8, 2.0)


def test_best_config_respects_the_floor_where_any_can(spark):
    runs = spark.createDataFrame([("a", 9.0, 3.0), ("b", 7.0, 12.0), ("c", 7.0, 15.0)], "config string, active_tracks double, fps double")
    assert audit.best_config(runs, 10).first().config == "c" and audit.best_config(runs, 99).first().config == "a"
    assert audit.best_config(runs.limit(0), 1).count() == 0


def test_signature_flatten_and_digest(spark):
    cells = [(0, 1), (2, 3), (2, 4)]
    rows = spark.createDataFrame([(1, cells), (2, cells[:1]), (3, []), (4, None)], "id int, c array<struct<row: int, col: int>>")
    got = {r.id: r.s for r in rows.select("id", gates.route_signature(F.col("c"), "local").alias("s")).collect()}
    want = lambda c: f"local-{zlib.crc32(repr(('local', c[0], c[-1], tuple(c))).encode()):08x}"
    assert got == {1: want(cells), 2: want(cells[:1]), 3: None, 4: None}
    assert flatten({"a": {"b": 1, "c": {"d": None}}, "e": [1]}) == {"a.b": 1, "a.c.d": None, "e": [1]}
    d = spark.createDataFrame([(1, "x", None), (1, "x", None), (1, "y", None)], "b int, a string, c string").select(audit.digest("b", "a", "c").alias("d")).collect()
    assert d[0] == d[1] != d[2]


def test_gates_have_to_be_passed_in_order(spark):
    steps = spark.createDataFrame([(t, k, 0, c) for t, walk in {1: [0, 1, 2], 2: [2, 1, 0], 3: [0, 0], 4: [2, 0, 2], 5: [1]}.items() for k, c in enumerate(walk)], "track_id int, seq int, row int, col int")
    cell = lambda *cols: spark.createDataFrame([(0, c) for c in cols], "row int, col int")
    assert {r.track_id for r in gates.passed_in_order(steps, cell(0), cell(2, 0)).collect()} == {1, 4}
    got = gates.zone_cells(spark, [("z", [(0.0, 0.0), (5.0, 0.0), (5.0, 10.0), (0.0, 10.0)]), ("all", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], 10, 10, 2, 2).collect()
    assert {(r.zone_id, r.row, r.col) for r in got} == {("z", 0, 0), ("z", 1, 0)} | {("all", r, c) for r in (0, 1) for c in (0, 1)}


def test_heading_stops_and_starts_at_different_speeds():
    h = K.Heading()
    got = [h.feed(t / 10, x, 0.0)[0] for t, x in enumerate([0, 1, 2, 3, 3.6, 4.1, 4.5, 4.8, 5.0, 5.1, 5.2, 5.3, 5.35, 5.4, 5.42, 5.44, 5.45])]
    assert got[:2] == ["unknown"] * 2 and got[2] == "moving" and got[9] == "moving" and got[-1] == "stationary"
    assert h.feed(5.0, 9, 9) == ("unknown", None, None, 0.0, 0.0) and h.feed(4.0, 9, 9)[0] == "unknown"
    h = K.Heading()
    state, ux, uy, quality, span = [h.feed(t / 10, 0.0, -5.0 * t) for t in range(11)][-1]
    assert (state, ux, uy) == ("moving", 0.0, -1.0) and quality == pytest.approx(1.0) and span == pytest.approx(1.0)


def test_dominant_direction_shows_the_way_most_tracks_go():
    e = E.DominantDirection(100, 100, E.GridRules(columns=10, rows=10, sample=0.5, least_age=0.1, every=1.0, short=5.0, gap=2.0))
    for k in range(30):
        e.feed(k / 4, [(t, 0, k, 5 + 3 * k, 20 + 10 * t) for t in range(3)] + [(9, 0, k, 90, 5 + 3 * k)])
    (path,) = e.paths
    assert path.direction == "east" and path.support_short == 3 and path.line[0][0] < path.line[1][0] and path.score == pytest.approx(0.75)
    e.feed(30.0, [])
    assert e.paths == () and [x for _, x in e.events][-1] == "retired"


def test_zone_occupancy_over_slots(spark):
    rows = [(k, "entry", "z", 100.0 * k, None) for k in range(5)] + [(k, "exit", "z", 100.0 * k + 250, 250.0) for k in range(4)] + [(0, "flow", "y>z", 0.0, None)]
    got = stateful.zone_metrics(spark.createDataFrame(rows, "track_id long, kind string, zone_id string, timestamp double, value double")).collect()
    assert [(r.zone_id, r.entries, r.exits, r.current_people, r.peak_occupancy) for r in got] == [("z", 5, 4, 1, 3)]
    one = stateful.zone_occupancy(spark.createDataFrame(rows, "track_id long, kind string, zone_id string, timestamp double, value double"), slot=100.0).first()
    assert (one.current_people, one.peak_occupancy) == (1, 3)


def test_mapping_goes_on_until_no_pair_is_left(spark):
    # each pair ties its ids to the next better one, so that a round maps one pair only
    n = 70
    rows = [(k, k, 2 * (n - k)) for k in range(n)] + [(k + 1, k, 2 * (n - k) - 1) for k in range(n)]
    m = spark.createDataFrame([(a, b) for a, b, c in rows for _ in range(c)], "a_id long, b_id long")
    assert {(r.a_id, r.b_id) for r in stateful.id_mapping(m).collect()} == {(k, k) for k in range(n)}


@pytest.mark.parametrize("ranges", [2, 3, 1000])
def test_nearest_rank_by_ranges(spark, ranges):
    values = [float(k * k % 97) for k in range(500)] + [None, 3.0, 3.0]
    got = summary.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.0, 0.5, 0.95, 1.0), ranges).first()
    s = sorted(v for v in values if v is not None)
    assert tuple(got) == (len(s), *(s[math.floor((len(s) - 1) * q)] for q in (0.0, 0.5, 0.95, 1.0)))


def test_cache_written_and_order_checked(spark, tmp_path):
    good = [f'{{"frame_id": {k}, "event_time_s": {k / 10}, "tracks": []}}' for k in range(50)]
    bad = [*good[:20], good[5], *good[20:30], '{"frame_id": 31, "event_time_s": 0.5, "tracks": []}']
    for name, rows in (("good", good), ("bad", bad)):
        (tmp_path / name).write_text("\n".join(rows))
    assert R.cache_order_errors(R.read_frame_cache(spark, str(tmp_path / "good"))).count() == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert R.cache_order_errors(R.read_frame_cache(spark, str(tmp_path / "good"))).count() == 0
        found = R.cache_order_errors(R.read_frame_cache(spark, str(tmp_path / "bad"))).collect()
        assert sorted((r.frame_id, r.event_time_s) for r in found) == [(5, 0.5), (31, 0.5)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    tracks = spark.createDataFrame([(1, 0.1, 7, 1.0, 2.0, 3.0, 4.0, 0.5, True), (2, 0.2, 7, 1.0, 2.0, 3.0, 4.0, 0.5, False)], "frame_id long, timestamp double, track_id long, x1 double, y1 double, x2 double, y2 double, confidence double, observed boolean")
    R.write_frame_cache(tracks, str(tmp_path / "out"))
    again = R.cache_tracks(R.read_frame_cache(spark, str(tmp_path / "out"))).select(tracks.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tracks.collect()))
    R.write_frame_metrics(spark.createDataFrame([(2, 0.12345678), (1, 1.0)], "frame long, recall double"), str(tmp_path / "csv"))
    assert R.artifact_problems(spark, str(tmp_path), ["out", "csv", "none"]) == ["missing: none", "unexpected: bad", "unexpected: good"]
    packed = R.pack_packets(spark.createDataFrame([(3, 0.5, bytearray(b"abc")), (4, 0.6, None)], "frame_id long, event_time_s double, body binary"), ["frame_id", "event_time_s"])
    got = R.unpack_packets(packed.select("packet")).collect()
    assert [(r.header.frame_id, r.header.event_time_s, bytes(r.body), r.problem) for r in got] == [(3, 0.5, b"abc", None), (4, 0.6, b"", None)]


def test_service_metrics(spark):
    from footfall.plans.service import Session

    points = spark.createDataFrame([("c", "e", 1, 1, 0.0, 1.0, 1.0, 1.0)], "camera_id string, stream_epoch string, track_id long, frame_id long, timestamp double, x double, y double, confidence double")
    s = Session(points, Settings())
    out = s.metrics(spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0)], "stage string, timestamp double, ms double"), spark.createDataFrame([(2, 2, 0, 2, 1.0)], "captured int, processed int, dropped int, detector_images int, elapsed double")).first()
    assert (out.p50, out.per_second, out.source_frames) == (2.0, 1.0, 2)
