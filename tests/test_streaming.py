import pytest
from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.functions import engines as E
from footfall.operators import stateful
from footfall.sources import adapter
from footfall.streaming import processors as P

DATA = "/root/testdata/sf0.001"
S = Settings()


@pytest.fixture
def stream(spark, tmp_path):
    """The points as a file stream of several micro-batches in event order."""
    p = adapter.frames(adapter.points(spark, DATA)).withColumn("frame_id", F.col("frame")).withColumn("timestamp", F.col("frame") / 25.0).drop("frame")
    cut = [(F.col("timestamp") >= a) & (F.col("timestamp") < a + 25) for a in (0, 25, 50)]
    for k, c in enumerate(cut):
        p.filter(c).coalesce(1).write.parquet(str(tmp_path / f"in/batch={k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/batch=*"))

    def run(df, mode="append"):
        name = f"out{abs(hash(str(tmp_path)))}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(60)
            return spark.table(name)
        finally:
            q.stop()

    return src, p, run


def rows(df, cols):
    return sorted(map(str, df.select(*[F.round(c, 6) if c in ("timestamp", "x", "y", "value") else F.col(c) for c in cols]).collect()))


def test_zone_events_equal_batch(stream):
    src, p, run = stream
    cols = ["track_id", "kind", "zone_id", "timestamp", "value"]
    # a batch also closes tracks that are idle at its end; here none is
    batch = stateful.zone_events(p, S.but(inactive_track_ttl_seconds=1000), adapter.ZONES)
    assert rows(run(P.zone_events(src, S.but(inactive_track_ttl_seconds=1000), adapter.ZONES)), cols) == rows(batch, cols)


def test_smoothing_equals_batch(stream):
    src, p, run = stream
    cols = ["track_id", "frame_id", "x", "y", "accepted", "confirmed"]
    assert rows(run(P.smoothed(src, S)), cols) == rows(stateful.smoothed(p, S), cols)


def test_paths_equal_batch(stream):
    src, p, run = stream
    make = lambda s: E.LiveFlow(s.width, s.height, E.FlowRules(columns=4, rows=2, look_back=(0.3, 3.0), history=4.0, least_tracks=1, confirm=0.5))
    f = p.withColumn("frame", F.col("frame_id"))
    whole = stateful.common_paths(f, "dominant_live_flow", S, changes=True, make=make)
    live = run(P.common_paths(src, S, "dominant_live_flow", make))
    cols = ["path_id", "state", "direction"]
    assert rows(live, cols) == rows(whole, cols)


def test_windows_by_watermark(stream):
    src, p, run = stream
    got = run(P.crowd_timeline(src, S), "complete")
    assert got.agg(F.sum("observations")).first()[0] == p.count()


def test_session_windows(stream):
    src, p, run = stream
    got = run(P.visits(src, "1 seconds"))
    assert got.count() > 0 and got.agg(F.max("points")).first()[0] <= p.count()
