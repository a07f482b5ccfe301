"""Registered queries with an exact SQL twin, over the driver's event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.config import Settings, flatten
from footfall.functions.geometry import COMPASS
from footfall.operators import audit, compare, flow, gates, heatmap, steps, summary, zones
from footfall.sources import adapter

S = Settings()
QUERIES: dict = {}
ORACLES: dict = {}

# ---- SQL building blocks -------------------------------------------------------------------
_P = f"""p AS (SELECT user_id AS track_id, event_id AS frame_id,
  (epoch_us(ts) - {adapter.EPOCH_US}) / {float(adapter.US_PER_SECOND)}::DOUBLE AS timestamp,
  least(value, {S.width}) AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events)"""
_ST = _P + """,
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(timestamp) OVER w AS pt FROM p WINDOW w AS (PARTITION BY track_id ORDER BY timestamp, frame_id)),
st AS (SELECT *, timestamp - pt AS dt, x - px AS dx, y - py AS dy, sqrt((x-px)*(x-px) + (y-py)*(y-py)) AS dist FROM l)"""
_MOVE = f"dt > 0 AND dt <= {S.max_point_gap_seconds} AND dist BETWEEN {S.movement_threshold} AND {S.max_movement_step}"
_FRAMES = _P + """,
f AS (SELECT floor(timestamp * 25)::BIGINT AS frame, track_id, max_by(frame_id, frame_id) AS frame_id, max_by(timestamp, frame_id) AS timestamp, max_by(x, frame_id) AS x, max_by(y, frame_id) AS y
      FROM p GROUP BY 1, 2),
pf AS (SELECT frame, count(DISTINCT track_id) AS people FROM f GROUP BY frame)"""


def _cell(v: str, extent: float, cells: int) -> str:
    return f"least({cells - 1}, floor({v} / {extent}::DOUBLE * {cells}))::INT"


def _fine(x: str = "x", y: str = "y") -> tuple[str, str]:
    return _cell(y, S.height, S.grid_height), _cell(x, S.width, S.grid_width)


def _macro(x: str, y: str) -> tuple[str, str]:
    return _cell(y, S.height, S.path_grid_height), _cell(x, S.width, S.path_grid_width)


def _label(x: str, y: str) -> str:
    r, c = _macro(x, y)
    return f"'R' || ({r} + 1) || 'C' || ({c} + 1)"


def _compass(dx: str, dy: str) -> str:
    names = ", ".join(f"'{c}'" for c in COMPASS)
    return f"CASE WHEN sqrt({dx}*{dx}+{dy}*{dy}) < 1e-6 THEN 'stationary' ELSE [{names}][1 + ((round_even(atan2({dy}, {dx}) / (pi()/4), 0)::INT + 8) % 8)] END"


def _bin(dx: str, dy: str, k: int) -> str:
    return f"(floor((((atan2({dy},{dx}) + 2*pi()) - floor((atan2({dy},{dx}) + 2*pi()) / (2*pi())) * 2*pi()) + pi()/{k}) / (2*pi()/{k}))::INT % {k})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _points(spark: SparkSession, d: str) -> DataFrame:
    return adapter.points(spark, d)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return adapter.frames(_points(spark, d))


def _run_b(points: DataFrame) -> DataFrame:
    """A second run: every fifth point missing, the others one unit to the right."""
    return points.filter("frame_id % 5 <> 0").withColumn("x", F.col("x") + 1)


R, C = _fine()
_ZONE = "CASE WHEN x <= 40 THEN 'a' WHEN x <= 100 THEN 'b' WHEN y <= 80 THEN 'c' END"


# ---- points, steps, heat -------------------------------------------------------------------
@query("normalize_points", f"WITH {_P} SELECT 'cam01' AS camera_id, track_id, frame_id, round(timestamp, 6) AS timestamp, x, y, {_ZONE} AS zone_id FROM p")
def normalize_points(spark, d):
    return zones.tagged(_points(spark, d), adapter.ZONES).select("camera_id", "track_id", "frame_id", F.round("timestamp", 6).alias("timestamp"), "x", "y", "zone_id")


@query("gap_segments", f"WITH {_ST} SELECT (track_id * 100 + sum(CASE WHEN dt > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY timestamp, frame_id))::BIGINT AS segment_id, frame_id FROM st")
def gap_segments(spark, d):
    return steps.gap_segments(_points(spark, d), 2.0).select((F.col("track_id") * 100 + F.col("segment")).alias("segment_id"), "frame_id")


_OCC = f"""{_ST}, o AS (SELECT floor(timestamp)::BIGINT AS bucket, {R} AS "row", {C} AS col, sum(least(dt, {S.max_point_gap_seconds})) AS occupancy
 FROM st WHERE dt > 0 AND dt <= {S.inactive_track_ttl_seconds} GROUP BY ALL)"""


@query("occupancy_heatmap", f'WITH {_OCC} SELECT "row", col, round(sum(occupancy), 6) AS occupancy FROM o GROUP BY ALL')
def occupancy_heatmap(spark, d):
    return heatmap.occupancy(_points(spark, d), S).groupBy("row", "col").agg(F.round(F.sum("occupancy"), 6).alias("occupancy"))


def _window(seconds: float) -> str:
    return f'WITH {_OCC} SELECT "row", col, round(sum(occupancy), 6) AS occupancy FROM o WHERE bucket >= floor(greatest(0, (SELECT max(timestamp) FROM p) - {seconds})) GROUP BY ALL'


def _occupancy_window(window: str):
    def run(spark, d):
        p = _points(spark, d)
        b = heatmap.occupancy(p, S).crossJoin(F.broadcast(p.agg(F.max("timestamp").alias("_now"))))
        return heatmap.snapshot(b, "occupancy", F.col("_now"), window, S).select("row", "col", F.round("occupancy", 6).alias("occupancy"))

    return run


query("occupancy_window_current", _window(S.current_window_seconds))(_occupancy_window("current"))
query("occupancy_window_1m", _window(60))(_occupancy_window("1m"))


@query("occupancy_normalised", f'WITH {_OCC}, t AS (SELECT "row", col, sum(occupancy) AS v FROM o GROUP BY ALL) SELECT "row", col, round(v / max(v) OVER (), 6) AS share FROM t')
def occupancy_normalised(spark, d):
    cells = heatmap.occupancy(_points(spark, d), S).groupBy("row", "col").agg(F.sum("occupancy").alias("occupancy"))
    return heatmap.normalised(cells, "occupancy").select("row", "col", F.round("share", 6).alias("share"))


_A, _B = _fine("px", "py"), _fine("x", "y")
_LINE = f"""{_ST}, a AS (SELECT dist, {_A[0]} AS r1, {_A[1]} AS c1, {_B[0]} AS r2, {_B[1]} AS c2 FROM st WHERE {_MOVE}),
n AS (SELECT *, greatest(abs(r2-r1), abs(c2-c1), 1) AS n FROM a),
g AS (SELECT *, unnest(generate_series(0, n)) AS i FROM n)"""


@query("movement_heatmap", f'WITH {_LINE} SELECT round_even(r1 + i*(r2-r1)/n::DOUBLE, 0)::INT AS "row", round_even(c1 + i*(c2-c1)/n::DOUBLE, 0)::INT AS col, round(sum(dist/(n+1)), 6) AS movement FROM g GROUP BY ALL')
def movement_heatmap(spark, d):
    return heatmap.movement(_points(spark, d), S).groupBy("row", "col").agg(F.round(F.sum("movement"), 6).alias("movement"))


# ---- flow ----------------------------------------------------------------------------------
_MID = _fine("((px+x)/2)", "((py+y)/2)")
_FIELD = f'{_ST}, fl AS (SELECT {_MID[0]} AS "row", {_MID[1]} AS col, sum(dx) AS vx, sum(dy) AS vy, count(*) AS samples FROM st WHERE {_MOVE} GROUP BY ALL)'


@query("direction_field", f'WITH {_FIELD} SELECT "row", col, round(vx, 6) AS vx, round(vy, 6) AS vy, samples FROM fl')
def direction_field(spark, d):
    return flow.direction_field(_points(spark, d), S).groupBy("row", "col").agg(F.round(F.sum("vx"), 6).alias("vx"), F.round(F.sum("vy"), 6).alias("vy"), F.sum("samples").alias("samples"))


@query("dominant_direction", f"WITH {_FIELD}, t AS (SELECT sum(vx) AS a, sum(vy) AS b, sum(samples)::BIGINT AS samples FROM fl) SELECT round(a, 4) AS vx, round(b, 4) AS vy, samples, {_compass('a', 'b')} AS direction FROM t")
def dominant_direction(spark, d):
    return flow.dominant_direction(flow.direction_field(_points(spark, d), S)).select(F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"), "samples", "direction")


_HB = _bin("dx", "dy", 8)


@query(
    "direction_histogram",
    f"""WITH {_ST}, s AS (SELECT {R} AS "row", {C} AS col, {_HB} AS bin, track_id, max(timestamp) AS last FROM st WHERE {_MOVE} GROUP BY ALL),
    n AS (SELECT max(timestamp) AS now FROM p)
    SELECT "row", col, bin, count(*) FILTER (WHERE now - last <= 10) AS short_tracks, count(*) FILTER (WHERE now - last <= 30) AS long_tracks FROM s, n GROUP BY ALL HAVING count(*) FILTER (WHERE now - last <= 30) > 0""",
)
def direction_histogram(spark, d):
    return flow.direction_histogram(_points(spark, d), S, 8, 10.0, 30.0)


_FROM, _TO = _macro("px", "py"), _macro("x", "y")
_EDGE = f"""{_ST}, m AS (SELECT timestamp, track_id, {_FROM[0]} AS from_row, {_FROM[1]} AS from_col, {_TO[0]} AS to_row, {_TO[1]} AS to_col FROM st WHERE {_MOVE}),
e AS (SELECT * FROM m WHERE from_row <> to_row OR from_col <> to_col)"""


@query("macro_edges", f"WITH {_EDGE} SELECT from_row, from_col, to_row, to_col, count(*) AS n FROM e GROUP BY ALL")
def macro_edges(spark, d):
    return flow.macro_edges(_points(spark, d), S).groupBy("from_row", "from_col", "to_row", "to_col").agg(F.sum("n").alias("n"))


_ROUTE = f"""{_ST}, s1 AS (SELECT *, CASE WHEN dt IS NULL OR dt > {S.inactive_track_ttl_seconds} THEN 1 ELSE 0 END AS fst, {_label("px", "py")} AS a, {_label("x", "y")} AS b FROM st),
s2 AS (SELECT *, sum(fst) OVER (PARTITION BY track_id ORDER BY timestamp, frame_id) AS stay FROM s1),
s3 AS (SELECT * FROM s2 WHERE fst = 1 OR ({_MOVE} AND a <> b)),
s4 AS (SELECT *, lag(b) OVER (PARTITION BY track_id, stay ORDER BY timestamp, frame_id) AS bef FROM s3),
s5 AS (SELECT track_id, stay, list(b ORDER BY timestamp, frame_id) AS cs FROM s4 WHERE bef IS NULL OR bef <> b GROUP BY ALL HAVING count(*) > 1),
rt AS (SELECT track_id, stay, CASE WHEN len(cs) <= {S.max_route_cells} THEN cs ELSE list_concat(cs[1:{S.max_route_cells - 1}], cs[-1:]) END AS cs FROM s5)"""


@query("top_routes", f"WITH {_ROUTE}, c AS (SELECT array_to_string(cs, ' -> ') AS label, count(*) AS walks FROM rt GROUP BY 1) SELECT label, walks, round(walks * 100.0 / (SELECT sum(walks) FROM c), 2) AS percentage FROM c ORDER BY walks DESC, label LIMIT 20")
def top_routes(spark, d):
    return flow.top_routes(flow.routes(_points(spark, d), S), 20)


@query("route_counts", f"WITH {_ROUTE} SELECT array_to_string(cs, ' -> ') AS label, count(*) AS walks FROM rt GROUP BY 1")
def route_counts(spark, d):
    return flow.route_counts(flow.routes(_points(spark, d), S)).drop("percentage")


@query("top_od_pairs", f"WITH {_ROUTE} SELECT cs[1] AS origin, cs[-1] AS destination, count(DISTINCT track_id) AS tracks FROM rt GROUP BY ALL ORDER BY tracks DESC, origin, destination LIMIT 20")
def top_od_pairs(spark, d):
    return flow.top_od_pairs(flow.routes(_points(spark, d), S), 1, 20)


@query(
    "directed_flow_scores",
    f"""WITH {_EDGE}, l2 AS (SELECT from_row, from_col, to_row, to_col, track_id, max(timestamp) AS last FROM e GROUP BY ALL),
    n AS (SELECT max(timestamp) AS now, min(timestamp) AS start FROM p),
    c AS (SELECT from_row, from_col, to_row, to_col, now, start, count(*) FILTER (WHERE now - last <= 10) AS s, count(*) FILTER (WHERE now - last <= 30) AS l FROM l2, n GROUP BY ALL)
    SELECT from_row, from_col, to_row, to_col, s AS short_tracks, l AS long_tracks,
     round(0.65 * s / least(10.0::DOUBLE, greatest(1.0::DOUBLE, now - start)) + 0.35 * l / least(30.0::DOUBLE, greatest(1.0::DOUBLE, now - start)), 6) AS score FROM c WHERE l > 0""",
)
def directed_flow_scores(spark, d):
    return flow.directed_flow(_points(spark, d), S, 10.0, 30.0)


@query(
    "edge_unique_tracks_decayed",
    f"""WITH {_EDGE}, b AS (SELECT DISTINCT from_row, from_col, to_row, to_col, floor(timestamp)::BIGINT AS b, track_id FROM e),
    n AS (SELECT max(timestamp) AS now FROM p),
    w AS (SELECT *, greatest(0, now - (b + 1)) AS age, (b + 1) > now - 10 AS sh FROM b, n WHERE (b + 1) > now - 30),
    s AS (SELECT from_row, from_col, to_row, to_col, sum(exp(-age/30)) AS wl, sum(CASE WHEN sh THEN exp(-age/10) ELSE 0 END) AS ws, count(DISTINCT track_id) AS long_tracks, count(DISTINCT track_id) FILTER (WHERE sh) AS short_tracks FROM w GROUP BY ALL)
    SELECT from_row, from_col, to_row, to_col, short_tracks, long_tracks, round(0.6 * ws / max(ws) OVER () + 0.4 * wl / max(wl) OVER (), 6) AS score FROM s""",
)
def edge_unique_tracks_decayed(spark, d):
    return flow.decayed_edges(_points(spark, d), S, 1.0, 10.0, 30.0)


@query("dominant_direction_vote", f"WITH {_ST} SELECT {_HB} AS bin, count(DISTINCT track_id) AS tracks FROM st WHERE {_MOVE} GROUP BY 1 HAVING count(DISTINCT track_id) >= 3 ORDER BY tracks DESC, bin LIMIT 1")
def dominant_direction_vote(spark, d):
    return flow.dominant_vote(_points(spark, d), S, 8, 3)


# ---- crowd ---------------------------------------------------------------------------------
@query("crowd_timeline", f"WITH {_FRAMES} SELECT floor(frame / 25.0)::BIGINT AS second, round(avg(people), 3) AS average, max(people) AS peak FROM pf GROUP BY 1")
def crowd_timeline(spark, d):
    return summary.timeline(_frames(spark, d), S)


@query(
    "crowd_average_locf",
    f"WITH {_FRAMES}, q AS (SELECT lag(people) OVER (ORDER BY frame) AS b, least((frame - lag(frame) OVER (ORDER BY frame)) / 25.0::DOUBLE, 2.0) AS w FROM pf) SELECT round(sum(b * w) / sum(w), 6) AS average_people FROM q WHERE b IS NOT NULL",
)
def crowd_average_locf(spark, d):
    return summary.average_locf(_frames(spark, d), S)


@query("crowd_summary", f"WITH {_FRAMES} SELECT max_by(people, frame) AS current_people, max(people) AS peak_people, count(*) AS frames, (SELECT count(DISTINCT track_id) FROM f) AS unique_tracks FROM pf")
def crowd_summary(spark, d):
    return summary.crowd_summary(_frames(spark, d))


@query("unique_tracks_retained", f"WITH {_P}, t AS (SELECT track_id, max(timestamp) AS last FROM p GROUP BY 1) SELECT count(*) AS tracks FROM t WHERE last >= (SELECT max(timestamp) FROM p) - 3")
def unique_tracks_retained(spark, d):
    return summary.unique_retained(_points(spark, d), 3.0)


@query(
    "corpus_validation",
    f"""WITH {_FRAMES}, a AS (SELECT count(*) AS points, count(DISTINCT track_id) AS tracks, min(frame) AS first_frame, max(frame) AS last_frame, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM f),
    b AS (SELECT count(*) AS frames, round(avg(people), 3) AS average_people, max(people) AS max_people, count(*) FILTER (WHERE people > 1) AS overlapping_frames FROM pf) SELECT * FROM a, b""",
)
def corpus_validation(spark, d):
    return summary.corpus_validation(_frames(spark, d))


_LIFE = _ST + ", lf AS (SELECT track_id, count(*) AS points, min(timestamp) AS a, max(timestamp) AS b, coalesce(sum(dist), 0) AS len FROM st GROUP BY 1)"


@query("track_lifecycle", f"WITH {_LIFE} SELECT track_id, points, round(a, 6) AS first_seen, round(b, 6) AS last_seen, round(len, 6) AS path_length FROM lf")
def track_lifecycle(spark, d):
    return summary.lifecycle(_points(spark, d)).select("track_id", "points", "first_seen", "last_seen", "path_length")


@query(
    "track_validity_reasons",
    f"""WITH {_LIFE}, r AS (SELECT CASE WHEN points < 60 THEN 'TOO_SHORT' WHEN round(b, 6) - round(a, 6) < 68 THEN 'SHORT_DURATION' WHEN round(len, 6) < 4000 THEN 'LOW_DISPLACEMENT'
     WHEN round(len, 6) <= 70 * (round(b, 6) - round(a, 6)) THEN 'STATIONARY' ELSE 'VALID' END AS reason FROM lf) SELECT reason, count(*) AS tracks FROM r GROUP BY 1""",
)
def track_validity_reasons(spark, d):
    return summary.validity(_points(spark, d), 68.0, 4000.0, 60, 70.0)


@query(
    "track_continuity",
    f"""WITH {_FRAMES}, g AS (SELECT track_id, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM f)
    SELECT track_id, count(*) AS observed, count(*) FILTER (WHERE gap > 25) + 1 AS fragments, count(*) FILTER (WHERE gap = 1) AS adjacent, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY 1""",
)
def track_continuity(spark, d):
    return summary.continuity(_frames(spark, d), 25).select("track_id", "observed", "fragments", "adjacent", "longest_gap")


@query(
    "cut_reasons",
    f"WITH {_ST} SELECT track_id, frame_id, CASE WHEN dt IS NULL THEN 'RAW_ID_START' WHEN dt > 2 THEN 'OBSERVATION_GAP' ELSE 'JUMP_THRESHOLD' END AS reason FROM st WHERE dt IS NULL OR dt > 2 OR dist > 80",
)
def cut_reasons(spark, d):
    return summary.cut_reasons(_points(spark, d), 2.0, 80.0)


@query(
    "active_intervals",
    f"""WITH {_FRAMES}, o AS (SELECT frame, people, CASE WHEN frame - lag(frame) OVER (ORDER BY frame) > 1 THEN 1 ELSE 0 END AS n FROM pf WHERE people >= 3),
    r AS (SELECT *, sum(n) OVER (ORDER BY frame) AS run FROM o) SELECT min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, max(people) AS peak FROM r GROUP BY run""",
)
def active_intervals(spark, d):
    return summary.active_intervals(_frames(spark, d), 3).select("first_frame", "last_frame", "frames", "peak")


@query(
    "id_starts_and_ends",
    f"""WITH {_FRAMES}, g AS (SELECT frame, lag(frame) OVER w AS b, lead(frame) OVER w AS a FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame))
    SELECT frame, count(*) AS tracks, count(*) FILTER (WHERE b IS NULL) AS started, count(*) FILTER (WHERE a IS NULL OR a - frame > 1) AS vanished FROM g GROUP BY 1""",
)
def id_starts_and_ends(spark, d):
    return summary.id_starts(_frames(spark, d))


@query(
    "stage_metrics",
    f"""WITH {_P}, u AS (UNPIVOT (SELECT x, y, timestamp FROM p) ON x, y, timestamp INTO NAME stage VALUE value)
    SELECT stage, count(*) AS samples, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top, round(sum(value), 6) AS total FROM u GROUP BY 1""",
)
def stage_metrics(spark, d):
    return summary.stage_metrics(_points(spark, d), ["x", "y", "timestamp"])


@query("nearest_rank_percentiles", f"WITH {_P}, r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM p) SELECT max(n) AS samples, max(x) FILTER (WHERE i = floor((n - 1) * 0.5)) AS p50, max(x) FILTER (WHERE i = floor((n - 1) * 0.95)) AS p95 FROM r")
def nearest_rank_percentiles(spark, d):
    return summary.nearest_rank(_points(spark, d), "x")


@query("minute_metrics", f'WITH {_FRAMES} SELECT floor(frame / 25.0 / 6)::BIGINT AS "window", count(*) AS frames, max(frame) - min(frame) AS span_frames, round(avg(people), 6) AS average, max(people) AS peak FROM pf GROUP BY 1')
def minute_metrics(spark, d):
    return summary.tumbling(_frames(spark, d), 6.0, S)


@query(
    "region_band_counts",
    f"WITH {_FRAMES}, b AS (SELECT floor(timestamp)::BIGINT AS second, least(2, floor(y * 3 / 100.0::DOUBLE))::INT AS b FROM f) SELECT second, count(*) FILTER (WHERE b = 0) AS band0, count(*) FILTER (WHERE b = 1) AS band1, count(*) FILTER (WHERE b = 2) AS band2 FROM b GROUP BY 1",
)
def region_band_counts(spark, d):
    return summary.band_counts(_frames(spark, d), S.height)


# ---- zones ---------------------------------------------------------------------------------
_CHG = f"""{_ST}, z1 AS (SELECT *, {_ZONE} AS z, CASE WHEN dt IS NULL OR dt > {S.inactive_track_ttl_seconds} THEN 1 ELSE 0 END AS fst FROM st),
z2 AS (SELECT *, sum(fst) OVER (PARTITION BY track_id ORDER BY timestamp, frame_id) AS stay FROM z1),
z3 AS (SELECT *, lag(z) OVER (PARTITION BY track_id, stay ORDER BY timestamp, frame_id) AS bz FROM z2),
ls AS (SELECT track_id, stay, max(timestamp) AS timestamp, max_by(z, (timestamp, frame_id)) AS z FROM z2 GROUP BY ALL),
lz AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY stay DESC) AS rk FROM ls),
ch AS (SELECT track_id, stay, timestamp, frame_id, 0 AS gone, bz AS "left", z AS entered FROM z3 WHERE z IS DISTINCT FROM bz
  UNION ALL SELECT track_id, stay, timestamp, 9223372036854775807, 1, z, NULL FROM lz WHERE z IS NOT NULL AND (rk > 1 OR (SELECT max(timestamp) FROM p) - timestamp > {S.inactive_track_ttl_seconds}))"""


@query("zone_membership", f"WITH {_P} SELECT coalesce({_ZONE}, 'outside') AS zone_id, count(*) AS points, count(DISTINCT track_id) AS tracks FROM p GROUP BY 1")
def zone_membership(spark, d):
    return zones.tagged(_points(spark, d), adapter.ZONES).groupBy(F.coalesce("zone_id", F.lit("outside")).alias("zone_id")).agg(F.count("*").alias("points"), F.countDistinct("track_id").alias("tracks"))


@query("zone_transitions_nodebounce", f"""WITH {_CHG}, u AS (SELECT entered AS zone_id, 1 AS i, 0 AS o FROM ch WHERE entered IS NOT NULL UNION ALL SELECT "left", 0, 1 FROM ch WHERE "left" IS NOT NULL) SELECT zone_id, sum(i)::BIGINT AS entries, sum(o)::BIGINT AS exits FROM u GROUP BY 1""")
def zone_transitions(spark, d):
    return zones.transitions(zones.changes(_points(spark, d), adapter.ZONES, S))


@query("zone_dwell_nodebounce", f"""WITH {_CHG}, v AS (SELECT *, lag(timestamp) OVER (PARTITION BY track_id, stay ORDER BY timestamp, gone, frame_id) AS since FROM ch) SELECT "left" AS zone_id, count(*) AS visits, round(avg(timestamp - since), 3) AS average_dwell FROM v WHERE "left" IS NOT NULL GROUP BY 1""")
def zone_dwell(spark, d):
    return zones.dwell(zones.changes(_points(spark, d), adapter.ZONES, S))


@query("zone_od_flows", f"WITH {_CHG}, v AS (SELECT track_id, entered, lag(entered) OVER (PARTITION BY track_id, stay ORDER BY timestamp, frame_id) AS b FROM ch WHERE entered IS NOT NULL) SELECT b AS from_zone, entered AS to_zone, count(DISTINCT track_id) AS tracks FROM v WHERE b <> entered GROUP BY ALL")
def zone_od_flows(spark, d):
    return zones.od_flows(zones.changes(_points(spark, d), adapter.ZONES, S))


@query("first_last_zone_flow", f"WITH {_P}, z AS (SELECT *, {_ZONE} AS z FROM p), e AS (SELECT track_id, count(*) AS n, min_by(z, (timestamp, frame_id)) FILTER (WHERE z IS NOT NULL) AS a, max_by(z, (timestamp, frame_id)) FILTER (WHERE z IS NOT NULL) AS b FROM z GROUP BY 1) SELECT a AS first_zone, b AS last_zone, count(*) AS tracks FROM e WHERE n >= 3 AND a <> b GROUP BY ALL")
def first_last_zone_flow(spark, d):
    return zones.first_last_flow(_points(spark, d), adapter.ZONES, S)


# ---- comparison of runs --------------------------------------------------------------------
_AB = _FRAMES + ", fb AS (SELECT floor(timestamp * 25)::BIGINT AS frame, track_id FROM p WHERE frame_id % 5 <> 0 GROUP BY ALL)"


def _two_runs(spark, d):
    p = _points(spark, d)
    return adapter.frames(p), adapter.frames(_run_b(p))


@query("run_diff_counts", f"WITH {_AB} SELECT coalesce(f.frame, fb.frame) AS frame, count(f.track_id) AS a_tracks, count(fb.track_id) AS b_tracks, count(*) FILTER (WHERE f.track_id IS NOT NULL AND fb.track_id IS NOT NULL) AS common FROM f FULL JOIN fb ON f.frame = fb.frame AND f.track_id = fb.track_id GROUP BY 1")
def run_diff_counts(spark, d):
    return compare.frame_diff(*_two_runs(spark, d))


@query("id_set_diff", f"WITH {_P}, a AS (SELECT DISTINCT track_id FROM p), b AS (SELECT DISTINCT track_id + CASE WHEN x > 150 THEN 1000000 ELSE 0 END AS track_id FROM p) SELECT track_id, 'a' AS only_in FROM a WHERE track_id NOT IN (SELECT track_id FROM b) UNION ALL SELECT track_id, 'b' FROM b WHERE track_id NOT IN (SELECT track_id FROM a)")
def id_set_diff(spark, d):
    # the second run gives tracks another id where they come near the right side
    p = _points(spark, d)
    return compare.id_diff(p, p.withColumn("track_id", F.col("track_id") + F.when(F.col("x") > 150, 1_000_000).otherwise(0)))


_CONF = {"grid": {"width": 64, "height": 36}, "zones": {"debounce": 2}, "alpha": 0.35}, {"grid": {"width": 64, "height": 18}, "paths": {"max": 5}, "alpha": 0.18}
_FLAT = "WITH a(key, a_value) AS (VALUES ('grid.width', '64'), ('grid.height', '36'), ('zones.debounce', '2'), ('alpha', '0.35')), b(key, b_value) AS (VALUES ('grid.width', '64'), ('grid.height', '18'), ('paths.max', '5'), ('alpha', '0.18'))"


@query("config_diff", f"{_FLAT} SELECT coalesce(a.key, b.key) AS key, a_value, b_value FROM a FULL JOIN b ON a.key = b.key WHERE a_value IS DISTINCT FROM b_value")
def config_diff(spark, d):
    return compare.config_diff(*(spark.createDataFrame([(k, str(v)) for k, v in flatten(c).items()], "key string, value string") for c in _CONF))


@query("count_error_metrics", f"WITH {_AB}, x AS (SELECT frame, count(DISTINCT track_id) AS n FROM f GROUP BY 1), y AS (SELECT frame, count(DISTINCT track_id) AS m FROM fb GROUP BY 1), e AS (SELECT n, coalesce(m, 0) - n AS d FROM x LEFT JOIN y USING (frame)) SELECT count(*) AS frames, round(avg(abs(d)), 6) AS mae, round(avg(abs(d) / n::DOUBLE) * 100, 6) AS mape, round(avg(d), 6) AS bias FROM e")
def count_error_metrics(spark, d):
    return compare.count_errors(*_two_runs(spark, d))


_ENDS = _P + """,
q AS (SELECT *, lead(x) OVER w - x AS nx, lead(y) OVER w - y AS ny, x - lag(x) OVER w AS bx, y - lag(y) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY track_id ORDER BY timestamp, frame_id)),
en AS (SELECT track_id, min(timestamp) AS t0, max(timestamp) AS t1, arg_min_null(x, (timestamp, frame_id)) AS x0, arg_min_null(y, (timestamp, frame_id)) AS y0, arg_min_null(nx, (timestamp, frame_id)) AS ux, arg_min_null(ny, (timestamp, frame_id)) AS uy,
 arg_max_null(x, (timestamp, frame_id)) AS x1, arg_max_null(y, (timestamp, frame_id)) AS y1, arg_max_null(bx, (timestamp, frame_id)) AS vx, arg_max_null(by_, (timestamp, frame_id)) AS vy FROM q GROUP BY 1)"""


@query(
    "id_switch_suspects",
    f"""WITH {_P.replace("user_id AS track_id", f"user_id * 1000 + floor((epoch_us(ts) - {adapter.EPOCH_US}) / {float(adapter.US_PER_SECOND)}::DOUBLE / 7.2)::BIGINT AS track_id")},{_ENDS.partition(",")[2].partition("FROM events),")[2]},
    j AS (SELECT a.track_id AS from_track, b.track_id AS to_track, sqrt((b.x0-a.x1)*(b.x0-a.x1)+(b.y0-a.y1)*(b.y0-a.y1)) AS dd, b.t0 - a.t1 AS gap,
      sqrt(a.vx*a.vx+a.vy*a.vy) * sqrt(b.ux*b.ux+b.uy*b.uy) AS nn, a.vx*b.ux+a.vy*b.uy AS dot FROM en a JOIN en b ON a.track_id <> b.track_id AND b.t0 > a.t1 AND b.t0 - a.t1 <= 0.64)
    SELECT from_track, to_track, round(dd, 6) AS distance, round(dd + 40 * gap, 6) AS cost FROM j WHERE dd <= 80 AND coalesce(CASE WHEN nn > 0 THEN dot / nn ELSE 1.0 END, 1.0) >= -0.2
    ORDER BY cost, from_track, to_track LIMIT 12""",
)
def id_switch_suspects(spark, d):
    # ten pieces of each track, and the twelve likeliest hand-overs: the report is a top list
    p = _points(spark, d).withColumn("track_id", F.col("track_id") * 1000 + F.floor(F.col("timestamp") / 7.2))
    return compare.switch_suspects(p, compare.default_switch_horizon(25.0), 80.0).orderBy("cost", "from_track", "to_track").limit(12)


@query("alive_intervals_join", f"WITH {_P}, l AS (SELECT track_id, min(timestamp) AS a, max(timestamp) AS b FROM p GROUP BY 1), t AS (SELECT unnest(generate_series(0, 71)) AS t) SELECT t, count(track_id) AS alive FROM t LEFT JOIN l ON t.t BETWEEN a AND b GROUP BY 1")
def alive_intervals_join(spark, d):
    return compare.alive(_points(spark, d), spark.range(72).withColumnRenamed("id", "t"))


@query(
    "ddcrp_neighbour_pairs",
    f"""WITH {_ENDS}, n AS (SELECT track_id FROM p GROUP BY 1 HAVING count(*) >= 3),
    v AS (SELECT en.track_id, x1 - x0 AS dx, y1 - y0 AS dy, (x0 + x1)/2 AS cx, (y0 + y1)/2 AS cy FROM en JOIN n USING (track_id) WHERE sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) > 1e-9),
    j AS (SELECT a.track_id, b.track_id AS other, acos(greatest(-1, least(1, (a.dx*b.dx+a.dy*b.dy) / (sqrt(a.dx*a.dx+a.dy*a.dy) * sqrt(b.dx*b.dx+b.dy*b.dy))))) AS theta,
      sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)) AS delta FROM v a JOIN v b ON a.track_id <> b.track_id),
    s AS (SELECT *, round(exp(-(theta/0.5)*(theta/0.5)) * exp(-(delta/40.0)*(delta/40.0)), 9) AS sc FROM j WHERE delta <= 40 AND theta <= 1.2),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sc DESC, other) AS k FROM s WHERE sc > 0.05)
    SELECT v.track_id, coalesce(other, v.track_id) AS linked, round(coalesce(sc, 0), 6) AS score FROM v LEFT JOIN (SELECT * FROM r WHERE k = 1) q USING (track_id)""",
)
def ddcrp_neighbour_pairs(spark, d):
    return compare.neighbour_pairs(_points(spark, d), S, 40.0, 1.2, 0.5, 0.05)


@query("direction_change_counts", f"WITH {_ST}, q AS (SELECT {_compass('dx', 'dy')} AS direction FROM st WHERE {_MOVE}) SELECT direction, count(*) AS steps FROM q GROUP BY 1")
def direction_change_counts(spark, d):
    from footfall.functions.geometry import compass

    return steps.steps(_points(spark, d)).filter(steps.is_move(S)).groupBy(compass(F.col("dx"), F.col("dy")).alias("direction")).agg(F.count("*").alias("steps"))


# ---- detections and decisions --------------------------------------------------------------
@query("ignore_region_filter", f"WITH {_FRAMES} SELECT track_id, count(*) AS boxes FROM f WHERE NOT (x/200 BETWEEN 0.1 AND 0.2 AND (y - 12)/100 BETWEEN 0.0 AND 0.5) AND NOT (x/200 BETWEEN 0.0 AND 0.05 AND (y - 12)/100 BETWEEN 0.5 AND 1.0) GROUP BY 1")
def ignore_region_filter(spark, d):
    from footfall.operators import detections

    kept = detections.outside(adapter.boxes(_frames(spark, d)), [(0.1, 0.0, 0.2, 0.5), (0.0, 0.5, 0.05, 1.0)], S.width, S.height)
    return kept.groupBy("track_id").agg(F.count("*").alias("boxes"))


@query("candidate_funnel", f"WITH {_ST}, r AS (SELECT track_id, CASE WHEN dt IS NULL THEN 'RAW_ID_START' WHEN dt > 2 THEN 'OBSERVATION_GAP' ELSE 'JUMP_THRESHOLD' END AS reason FROM st WHERE dt IS NULL OR dt > 2 OR dist > 80) SELECT reason, count(*) AS rows, count(DISTINCT track_id) AS tracks, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS share FROM r GROUP BY 1")
def candidate_funnel(spark, d):
    from footfall.operators import detections

    return detections.funnel(summary.cut_reasons(_points(spark, d), 2.0, 80.0))


@query("confidence_bands", f"WITH {_P}, b AS (SELECT CASE WHEN y / 100 >= 0.5 THEN 'high' WHEN y / 100 >= 0.1 THEN 'low' ELSE 'dropped' END AS band FROM p) SELECT band, count(*) AS boxes FROM b GROUP BY 1")
def confidence_bands(spark, d):
    from footfall.operators import detections

    return _points(spark, d).withColumn("confidence", F.col("y") / 100).groupBy(detections.confidence_band(0.5, 0.1).alias("band")).agg(F.count("*").alias("boxes"))


@query("zone_switches", f"WITH {_P}, z AS (SELECT track_id, timestamp, coalesce({_ZONE}, 'outside') AS path_id, lag(coalesce({_ZONE}, 'outside')) OVER (PARTITION BY track_id ORDER BY timestamp) AS b FROM p), a AS (SELECT track_id, min(timestamp) AS f, max(timestamp) AS l, count(*) FILTER (WHERE b <> path_id) AS n FROM z GROUP BY 1) SELECT track_id, round(f, 6) AS first_active, n AS switches, round(n / greatest((l - f) / 60, 1/60::DOUBLE), 6) AS per_minute FROM a")
def zone_switches(spark, d):
    from footfall.operators import detections

    t = zones.tagged(_points(spark, d), adapter.ZONES).withColumn("path_id", F.coalesce("zone_id", F.lit("outside")))
    return detections.switches(t, ("track_id",)).select("track_id", F.round("first_active", 6).alias("first_active"), "switches", "per_minute")


@query(
    "adjacent_overlap",
    f"""WITH {_FRAMES}, j AS (SELECT greatest(0, 12 - abs(a.x - b.x)) * greatest(0, 24 - abs(a.y - b.y)) AS i FROM f a JOIN f b ON a.track_id = b.track_id AND b.frame = a.frame + 1)
    SELECT count(*) AS pairs, count(*) FILTER (WHERE i / (576 - i) >= 0.3) AS overlapping, round(avg(i / (576 - i)), 6) AS mean_overlap FROM j""",
)
def adjacent_overlap(spark, d):
    from footfall.operators import detections

    return detections.adjacent_overlap(adapter.boxes(_frames(spark, d)))


# ---- gates, digests, figures of runs -------------------------------------------------------
_CELLS = f"""cells AS (SELECT r AS "row", c AS col, (c + 0.5) * {S.width} / {S.path_grid_width} AS x, (r + 0.5) * {S.height} / {S.path_grid_height} AS y
  FROM (SELECT unnest(range({S.path_grid_height}))::INT AS r), (SELECT unnest(range({S.path_grid_width}))::INT AS c)),
zc AS (SELECT 'a' AS zone_id, "row", col FROM cells WHERE x <= 40 UNION ALL SELECT 'b', "row", col FROM cells WHERE x BETWEEN 40 AND 100 UNION ALL SELECT 'c', "row", col FROM cells WHERE x >= 100 AND y <= 80)"""


def _zone_cells(spark):
    return gates.zone_cells(spark, adapter.ZONES, S.width, S.height, S.path_grid_width, S.path_grid_height)


@query("zone_cells", f"WITH {_CELLS} SELECT zone_id, \"row\", col FROM zc")
def zone_cells(spark, d):
    return _zone_cells(spark)


_MR, _MC = _macro("x", "y")


@query(
    "gate_order",
    f"""WITH {_P}, {_CELLS}, st AS (SELECT track_id, timestamp, {_MR} AS r, {_MC} AS c FROM p),
    g AS (SELECT track_id, min(timestamp) FILTER (WHERE z.zone_id = 'a') AS first_origin, max(timestamp) FILTER (WHERE z.zone_id = 'c') AS last_goal FROM st JOIN zc z ON z."row" = st.r AND z.col = st.c GROUP BY 1)
    SELECT track_id, round(first_origin, 6) AS first_origin, round(last_goal, 6) AS last_goal FROM g WHERE first_origin < last_goal""",
)
def gate_order(spark, d):
    cell = steps.macro_cell(F.col("x"), F.col("y"), S)
    tracks = _points(spark, d).select("track_id", F.col("timestamp").alias("seq"), cell["row"].alias("row"), cell["col"].alias("col"))
    z = _zone_cells(spark)
    out = gates.passed_in_order(tracks, z.filter("zone_id = 'a'"), z.filter("zone_id = 'c'"))
    return out.select("track_id", F.round("first_origin", 6).alias("first_origin"), F.round("last_goal", 6).alias("last_goal"))


def _two_clocks(spark, d):
    """Frames of two runs; the second lacks every eleventh and is late on every seventh."""
    a = _frames(spark, d).select(F.col("frame").alias("frame_id"), (F.col("frame") / 25.0).alias("event_time_s")).distinct()
    return a, a.filter("frame_id % 11 <> 0").withColumn("event_time_s", F.col("event_time_s") + F.when(F.col("frame_id") % 7 == 0, 0.01).otherwise(0.0))


@query("run_agreement", f"WITH {_FRAMES}, a AS (SELECT DISTINCT frame AS frame_id, frame / 25.0::DOUBLE AS t FROM f), b AS (SELECT frame_id, t + CASE WHEN frame_id % 7 = 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS t FROM a WHERE frame_id % 11 <> 0) SELECT a.frame_id, a.t AS a_time, b.t AS b_time, CASE WHEN b.t IS NULL THEN 'ONLY_IN_A' ELSE 'TIMESTAMP_DIFFERS' END AS problem FROM a LEFT JOIN b USING (frame_id) WHERE b.t IS NULL OR abs(a.t - b.t) > 1e-6")
def run_agreement(spark, d):
    return audit.disagreements(*_two_clocks(spark, d))


@query(
    "substantive_changes",
    f"""WITH {_FRAMES}, g AS (SELECT frame, track_id, x, y, CASE WHEN track_id % 3 = 0 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END AS m, CASE WHEN track_id % 5 = 0 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS k FROM f)
    SELECT frame AS frame_id, track_id AS "rank", track_id::VARCHAR AS a_path, CASE WHEN track_id % 7 = 0 THEN 'new' ELSE track_id::VARCHAR END AS b_path, round(k, 6) AS confidence_delta, round(m, 6) AS mean_distance,
      track_id % 7 = 0 OR k > 0.01 OR m > 5 AS substantive FROM g""",
)
def substantive_changes(spark, d):
    at = lambda dx: F.array(F.struct((F.col("x") + dx).alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + 9 + dx).alias("x"), F.col("y").alias("y")))
    f = _frames(spark, d).select(F.col("frame").alias("frame_id"), F.col("track_id").alias("rank"), "x", "y")
    base = f.select("frame_id", "rank", F.col("rank").cast("string").alias("path_id"), F.lit("east").alias("direction"), F.lit(3).alias("support_tracks"), F.lit(0.5).alias("confidence"), at(F.lit(0.0)).alias("line"))
    other = f.select(
        "frame_id", "rank", F.when(F.col("rank") % 7 == 0, "new").otherwise(F.col("rank").cast("string")).alias("path_id"), F.lit("east").alias("direction"), F.lit(3).alias("support_tracks"),
        F.when(F.col("rank") % 5 == 0, 0.52).otherwise(0.5).alias("confidence"), at(F.when(F.col("rank") % 3 == 0, 6.0).otherwise(1.0)).alias("line"),
    )
    return audit.path_changes(base, other)


@query("track_digests", f"WITH {_P} SELECT track_id, sha256('{{\"points\":' || count(*) || ',\"track_id\":' || track_id || '}}') AS digest FROM p GROUP BY 1")
def track_digests(spark, d):
    return _points(spark, d).groupBy("track_id").agg(F.count("*").alias("points")).select("track_id", audit.digest("track_id", "points").alias("digest"))


@query("route_signatures")
def route_signatures(spark, d):
    found = flow.routes(_points(spark, d), S)
    part = lambda c, k: (F.regexp_extract(c, r"^R(\d+)C(\d+)$", k).cast("int") - 1)
    cells = F.transform("cells", lambda c: F.struct(part(c, 1).alias("row"), part(c, 2).alias("col")))
    return found.groupBy(gates.route_signature(cells, "grid").alias("signature")).agg(F.count("*").alias("walks"))


_STAGED = f"SELECT event_type AS stage, (epoch_us(ts) - {adapter.EPOCH_US}) / {float(adapter.US_PER_SECOND)}::DOUBLE AS timestamp, value AS ms, user_id FROM events"


def _staged(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("stage"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(adapter.EPOCH_US)) / F.lit(float(adapter.US_PER_SECOND))).alias("timestamp"), F.col("value").alias("ms"), "user_id")


@query(
    "performance_monitor",
    f"""WITH e AS ({_STAGED}), r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY timestamp DESC, ms DESC) AS k FROM e)
    SELECT stage, count(*) AS samples, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round((count(*) - 1) / (max(timestamp) - min(timestamp)), 3) AS per_second FROM r WHERE k <= {audit.SAMPLES} GROUP BY 1""",
)
def performance_monitor(spark, d):
    return audit.performance(_staged(spark, d))


@query("best_config", f"WITH e AS ({_STAGED}), c AS (SELECT stage AS config, count(DISTINCT user_id) AS active_tracks, round(count(*) / 72.0::DOUBLE, 6) AS fps FROM e GROUP BY 1) SELECT config, active_tracks, fps, fps >= 27.7 AS at_floor FROM c ORDER BY fps >= 27.7 DESC, active_tracks DESC, fps DESC, config DESC LIMIT 1")
def best_config(spark, d):
    runs = _staged(spark, d).groupBy(F.col("stage").alias("config")).agg(F.countDistinct("user_id").alias("active_tracks"), F.round(F.count("*") / 72.0, 6).alias("fps"))
    return audit.best_config(runs, 27.7)
