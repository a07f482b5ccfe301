"""What callers can ask of a session's or corpus's points: the service functions behind the endpoints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.functions.geometry import project
from footfall.operators import audit, flow, heatmap, stateful, summary, zones
from footfall.operators.steps import eligible

METRICS = ("occupancy", "movement")


class Session:
    """Points of one analysis (camera_id, stream_epoch, track_id, frame_id, timestamp, x, y, confidence) with settings and zones."""

    def __init__(self, points: DataFrame, settings: Settings, zone_list: list | None = None):
        self.all, self.s, self.zones = points, settings, zone_list or []
        self.points = eligible(points, settings)

    def frames(self) -> DataFrame:
        return self.all.withColumn("frame", F.col("frame_id"))

    def summary(self) -> DataFrame:
        return summary.crowd_summary(self.frames()).crossJoin(F.broadcast(summary.average_locf(self.frames(), self.s)))

    def timeline(self) -> DataFrame:
        return summary.timeline(self.frames(), self.s)

    def heatmap(self, metric: str = "occupancy", window: str = "current") -> DataFrame:
        if metric not in METRICS or window not in heatmap.WINDOWS:
            raise ValueError(f"metric is one of {METRICS}, window one of {tuple(heatmap.WINDOWS)}")
        buckets = getattr(heatmap, metric)(self.points, self.s)
        now = F.broadcast(self.points.agg(F.max("timestamp").alias("_now")))
        return heatmap.normalised(heatmap.snapshot(buckets.crossJoin(now), metric, F.col("_now"), window, self.s), metric)

    def flow(self, window: str = "current") -> DataFrame:
        field = flow.direction_field(self.points, self.s)
        now = F.broadcast(self.points.agg(F.max("timestamp").alias("_now")))
        b = field.crossJoin(now)
        sums = [heatmap.snapshot(b, c, F.col("_now"), window, self.s) for c in ("vx", "vy", "samples")]
        return sums[0].join(sums[1], ["row", "col"]).join(sums[2], ["row", "col"])

    def metrics(self, samples: DataFrame, run: DataFrame) -> DataFrame:
        """Performance of each stage beside the run's counters; columns as ``audit.performance`` and ``audit.counters`` take them."""
        return audit.performance(samples).crossJoin(F.broadcast(audit.counters(run)))

    def top_paths(self, limit: int = 5) -> DataFrame:
        """Routes and zone flows together, zone flows only where no route has their label."""
        if not 1 <= limit <= 20:
            raise ValueError("between 1 and 20 paths can be asked for")
        a = flow.top_routes(flow.routes(self.points, self.s), limit).withColumn("kind", F.lit("grid"))
        if self.zones:
            z = self.zone_flows().select(F.concat_ws(" -> ", "from_zone", "to_zone").alias("label"), F.col("tracks").alias("walks"))
            total = F.broadcast(z.agg(F.sum("walks").alias("_all")))
            z = z.crossJoin(total).withColumn("percentage", F.round(F.col("walks") * 100.0 / F.col("_all"), 2)).drop("_all").withColumn("kind", F.lit("zone"))
            a = a.unionByName(z.join(a.select("label"), "label", "left_anti"))
        return a.orderBy(F.desc("walks"), "kind", "label").limit(limit)

    def zone_metrics(self) -> DataFrame:
        return stateful.zone_metrics(stateful.zone_events(self.points, self.s, self.zones))

    def zone_flows(self) -> DataFrame:
        e = stateful.zone_events(self.points, self.s, self.zones).filter("kind = 'flow'")
        pair = F.split("zone_id", ">")
        return e.groupBy(pair[0].alias("from_zone"), pair[1].alias("to_zone")).agg(F.count("*").alias("tracks")).orderBy(F.desc("tracks"), "from_zone", "to_zone")

    def common_paths(self, engine: str = "tracklet_aggregation") -> DataFrame:
        return stateful.shadowed(self.frames(), self.s) if engine == "shadow" else stateful.common_paths(self.frames(), engine, self.s)

    def directed_flows(self, short: float = 30.0, long: float = 180.0) -> DataFrame:
        return flow.directed_flow(self.points, self.s, short, long)

    def in_ground_plane(self, homography: list[list[float]], corners: list[tuple[float, float]]) -> Session:
        """The session on the ground: points and zones projected, the plane as large as the corners need, movement gates in metres."""

        def image(x: float, y: float) -> tuple[float, float]:
            w = homography[2][0] * x + homography[2][1] * y + homography[2][2]
            if abs(w) <= 1e-12:
                raise ValueError("a corner or zone lies on the horizon")
            return tuple((r[0] * x + r[1] * y + r[2]) / w for r in homography[:2])

        ends = [image(*c) for c in corners]
        x, y = project(F.col("x"), F.col("y"), homography)
        s = self.s.but(width=math.ceil(max(p[0] for p in ends)) + 1.0, height=math.ceil(max(p[1] for p in ends)) + 1.0, movement_threshold=0.15, max_movement_step=12.0)
        return Session(self.all.withColumns({"x": x, "y": y}), s, [(n, [image(*p) for p in pts]) for n, pts in self.zones])

    def report(self) -> dict[str, DataFrame]:
        """The result document of an offline analysis, part by part."""
        return {"summary": self.summary(), "timeline": self.timeline(), "occupancy": self.heatmap("occupancy", "entire"), "movement": self.heatmap("movement", "entire"), "flow": self.flow("entire"), "paths": self.top_paths(), "zones": self.zone_metrics() if self.zones else zones.transitions(zones.changes(self.points, [("none", [(-1.0, -1.0), (-1.0, -2.0), (-2.0, -1.0)])], self.s)), "validation": summary.corpus_validation(self.frames())}
