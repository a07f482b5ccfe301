"""Registered queries of state machines, matching and path engines; few have an SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.functions import engines as E
from footfall.functions import tracks as K
from footfall.operators import stateful as O
from footfall.plans.relational import _FRAMES, _P
from footfall.sources import adapter

S = Settings()
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def _frames(spark, d):
    return adapter.frames(adapter.points(spark, d))


def _second(spark, d):
    return adapter.frames(adapter.points(spark, d).filter("frame_id % 5 <> 0").withColumn("x", F.col("x") + 1))


@query("smoothed_trajectories")
def smoothed_trajectories(spark, d):
    return O.smoothed(adapter.points(spark, d), S)


@query("direction_estimates")
def direction_estimates(spark, d):
    h = O.headings(adapter.points(spark, d), S)
    return h.select("track_id", "frame_id", "state", *[F.round(c, 6).alias(c) for c in ("ux", "uy", "quality", "span")])


@query("completed_tracklets")
def completed_tracklets(spark, d):
    return O.tracklets(adapter.points(spark, d), S.but(track_buffer_frames=400), adapter.ZONES)


@query("zone_metrics_debounced")
def zone_metrics_debounced(spark, d):
    return O.zone_metrics(O.zone_events(adapter.points(spark, d), S, adapter.ZONES))


@query("point_match_eval")
def point_match_eval(spark, d):
    return O.point_evaluation(_frames(spark, d), _second(spark, d), 60.0)


@query("iou_match_eval")
def iou_match_eval(spark, d):
    m = O.box_matches(adapter.boxes(_frames(spark, d)), adapter.boxes(_second(spark, d)), 0.5)
    same = F.count(F.when(F.col("a_id") == F.col("b_id"), 1))
    return m.agg(F.count("*").alias("matches"), same.alias("same_ids"), F.round(F.percentile("overlap", F.lit(0.5)), 6).alias("overlap_p50"), F.round(F.percentile("edge_error", F.lit(0.95)), 6).alias("edge_error_p95"))


@query("track_id_mapping")
def track_id_mapping(spark, d):
    return O.id_mapping(O.box_matches(adapter.boxes(_frames(spark, d)), adapter.boxes(_second(spark, d)), 0.5))


@query("nms_merge")
def nms_merge(spark, d):
    f = _frames(spark, d)
    one = adapter.boxes(f).withColumns({"box_id": F.col("track_id") * 2, "source": F.lit(0)})
    two = adapter.boxes(f, shift=1.0).withColumns({"box_id": F.col("track_id") * 2 + 1, "source": F.lit(1)})
    both = one.unionByName(two).withColumns({"kind": F.lit(0), "confidence": 1 - (F.col("box_id") % 7) / 20})
    return O.merged_tiles(both)


@query("track_association")
def track_association(spark, d):
    f = adapter.frames(adapter.points(spark, d), 5.0)
    b = adapter.boxes(f).withColumns({"camera_id": F.lit("cam01"), "stream_epoch": F.lit("e0"), "box_id": F.col("track_id"), "confidence": F.lit(0.9)}).drop("track_id")
    return O.tracked(b)


def _paths(engine: str, make=None):
    def run(spark, d):
        # second frames, so that a track is seen often enough to have steps
        f = adapter.frames(adapter.points(spark, d), 2.0)
        out = O.common_paths(f, engine, S.but(fps=2.0), make=make)
        return out.withColumn("line", F.to_json("line")).drop("camera_id", "stream_epoch")

    return run


query("legacy_common_paths")(_paths("legacy", lambda s: E.LegacyPaths(s.width, s.height, E.LegacyRules(columns=8, rows=5, confirm_points=1, least_tracks=2, edge_tracks=1, alike=0.2, confirm=1.0))))
query("directional_paths")(_paths("directional_grid", lambda s: E.DirectionalGrid(s.width, s.height, E.GridRules(columns=8, rows=5, gap=2.0, sample=1.0, edge_tracks=2, support=2, complete=1, confirm=3, every=1))))
query("dominant_direction_path")(_paths("dominant_direction", lambda s: E.DominantDirection(s.width, s.height, E.GridRules(columns=8, rows=5, gap=2.0, sample=1.0, every=1))))
query("live_flow_path")(_paths("dominant_live_flow", lambda s: E.LiveFlow(s.width, s.height, E.FlowRules(columns=8, rows=5, look_back=(0.3, 1.5)))))
query("tracklet_common_paths")(_paths("tracklet_aggregation", lambda s: E.TrackletPaths(s.width, s.height, E.TrackletRules(gap=2.0, step=0.5, stretch=6.0, straight=0.1, near=0.15, every=12.0))))


@query("shadow_common_paths")
def shadow_common_paths(spark, d):
    return O.shadowed(adapter.frames(adapter.points(spark, d), 2.0), S.but(fps=2.0)).withColumn("line", F.to_json("line")).drop("camera_id", "stream_epoch")


@query("ddcrp_paths")
def ddcrp_paths(spark, d):
    return O.linked_paths(adapter.points(spark, d), S).withColumn("line", F.to_json("line")).drop("camera_id", "stream_epoch")


@query("scan_schedule")
def scan_schedule(spark, d):
    from footfall.operators import detections

    return detections.scan_schedule(_frames(spark, d), 3)


ORACLES["scan_schedule"] = f"""WITH RECURSIVE {_FRAMES}, fr AS MATERIALIZED (SELECT DISTINCT frame FROM f),
nx AS MATERIALIZED (SELECT a.frame, min(b.frame) AS nxt FROM fr a JOIN fr b ON b.frame >= a.frame + 3 GROUP BY 1),
s AS (SELECT min(frame) AS frame, false AS missed FROM fr UNION ALL SELECT nxt, nxt - s.frame > 3 FROM s JOIN nx ON nx.frame = s.frame)
SELECT 'cam01' AS camera_id, 'e0' AS stream_epoch, frame, missed FROM s"""

_SECOND = f"""WITH RECURSIVE {_FRAMES},
g AS (SELECT floor(timestamp * 25)::BIGINT AS frame, track_id, max_by(x + 1, frame_id) AS x, max_by(y, frame_id) AS y FROM p WHERE frame_id % 5 <> 0 GROUP BY 1, 2)"""
_NEAR = """, near AS (SELECT f.frame, f.track_id AS a, g.track_id AS b, sqrt((f.x - g.x) * (f.x - g.x) + (f.y - g.y) * (f.y - g.y)) AS distance FROM f JOIN g ON g.frame = f.frame),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY distance, a, b) AS k FROM near WHERE distance <= 60)"""
_OVERLAP = """, bx AS (SELECT f.frame, f.track_id AS a, g.track_id AS b, f.x - 6 AS l, f.x + 6 AS r, f.y - 24 AS o, f.y AS u, g.x - 6 AS gl, g.x + 6 AS gr, g.y - 24 AS g_o, g.y AS gu FROM f JOIN g ON g.frame = f.frame),
i AS (SELECT *, greatest(least(r, gr) - greatest(l, gl), 0) * greatest(least(u, gu) - greatest(o, g_o), 0) AS common FROM bx),
shares AS (SELECT frame, a, b, common / ((r - l) * (u - o) + (gr - gl) * (gu - g_o) - common) AS overlap, greatest(abs(l - gl), abs(r - gr), abs(o - g_o), abs(u - gu)) AS edge_error FROM i),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY overlap DESC, a, b) AS k FROM shares WHERE overlap >= 0.5)"""


def _greedy(pairs: str, walk: str, taken: str) -> str:
    """SQL: ``taken`` are the pairs of each frame that come up, by rank k, while both their ids are free."""
    return f""", {walk} AS (SELECT frame, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS hit FROM {pairs} WHERE k = 1
UNION ALL SELECT frame, k, CASE WHEN free THEN list_append(ua, a) ELSE ua END, CASE WHEN free THEN list_append(ub, b) ELSE ub END, free
FROM (SELECT q.frame, q.k, q.a, q.b, ua, ub, NOT list_contains(ua, q.a) AND NOT list_contains(ub, q.b) AS free FROM {walk} w JOIN {pairs} q ON q.frame = w.frame AND q.k = w.k + 1)),
{taken} AS MATERIALIZED (SELECT q.* FROM {walk} w JOIN {pairs} q ON q.frame = w.frame AND q.k = w.k WHERE hit)"""


ORACLES["point_match_eval"] = f"""{_SECOND}{_NEAR}{_greedy("c", "t", "m")},
n AS (SELECT count(*) AS truth_points, count(DISTINCT track_id) AS tt, count(DISTINCT frame) AS tf FROM f),
fo AS (SELECT count(*) AS found_points, count(DISTINCT track_id) AS ft FROM g WHERE frame IN (SELECT frame FROM f)),
mm AS (SELECT count(*) AS matches, round(avg(distance), 6) AS mean_distance, round(median(distance), 6) AS median_distance, count(DISTINCT a) AS mt, count(DISTINCT b) AS mf, count(DISTINCT frame) AS mfr FROM m)
SELECT truth_points, found_points, matches, round(matches / found_points, 6) AS precision, round(matches / truth_points, 6) AS recall, round(mfr / tf, 6) AS frame_coverage,
round(mt / tt, 6) AS truth_track_coverage, round(mf / ft, 6) AS found_track_coverage, mean_distance, median_distance FROM n, fo, mm"""
ORACLES["iou_match_eval"] = f"""{_SECOND}{_OVERLAP}{_greedy("c", "t", "m")}
SELECT count(*) AS matches, count(*) FILTER (WHERE a = b) AS same_ids, round(quantile_cont(overlap, 0.5), 6) AS overlap_p50, round(quantile_cont(edge_error, 0.95), 6) AS edge_error_p95 FROM m"""
ORACLES["track_id_mapping"] = f"""{_SECOND}{_OVERLAP}{_greedy("c", "t", "m")},
pairs AS MATERIALIZED (SELECT 0 AS frame, a, b, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, a, b) AS k FROM m GROUP BY a, b){_greedy("pairs", "z", "mapped")}
SELECT a AS a_id, b AS b_id, n FROM mapped"""
#: A track's points by rank, each eased towards the last accepted one.
ORACLES["smoothed_trajectories"] = f"""WITH RECURSIVE {_P},
r AS MATERIALIZED (SELECT track_id, frame_id, timestamp, x, y, row_number() OVER (PARTITION BY track_id ORDER BY timestamp, frame_id) AS k FROM p),
s AS (SELECT track_id, k, timestamp, x AS sx, y AS sy, 1 AS accepted, true AS hit FROM r WHERE k = 1
UNION ALL SELECT track_id, k, timestamp, CASE WHEN hit THEN nx ELSE sx END, CASE WHEN hit THEN ny ELSE sy END, CASE WHEN fresh THEN 1 ELSE accepted + hit::INT END, hit
FROM (SELECT *, fresh OR sqrt((nx - sx) * (nx - sx) + (ny - sy) * (ny - sy)) >= {S.min_point_distance} AS hit
FROM (SELECT *, CASE WHEN fresh THEN x ELSE w * tx + (1 - w) * sx END AS nx, CASE WHEN fresh THEN y ELSE w * ty + (1 - w) * sy END AS ny
FROM (SELECT *, CASE WHEN far THEN sx ELSE x END AS tx, CASE WHEN far THEN sy ELSE y END AS ty, {S.smoothing_alpha}::DOUBLE * CASE WHEN far OR step < {K.JITTER} THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS w
FROM (SELECT *, step > {S.max_movement_step} AS far
FROM (SELECT r.*, s.sx, s.sy, s.accepted, r.timestamp - s.timestamp > {S.inactive_track_ttl_seconds} AS fresh, sqrt((r.x - sx) * (r.x - sx) + (r.y - sy) * (r.y - sy)) AS step
FROM s JOIN r ON r.track_id = s.track_id AND r.k = s.k + 1))))))
SELECT 'cam01' AS camera_id, 'e0' AS stream_epoch, track_id, frame_id, s.timestamp, sx AS x, sy AS y, accepted, accepted >= {S.min_confirmed_points} AS confirmed FROM s JOIN r USING (track_id, k) WHERE hit"""
