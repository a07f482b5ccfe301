"""Readers and writers of trajectory data: Parquet, CSV, JSON lines, annotation text, zones, homographies."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.geometry import project, zone_at

POINTS = (
    "camera_id string, source string, frame_id bigint, timestamp double, track_id bigint, x double, y double, x1 double, y1 double, x2 double, y2 double,"
    " foot_x double, foot_y double, world_x double, world_y double, confidence double, zone_id string"
)
NEEDED = ("camera_id", "source", "frame_id", "timestamp", "track_id", "foot_x", "foot_y")
BOX = "array<struct<x1: double, y1: double, x2: double, y2: double, confidence: double, class_id: int>>"
TRACK = "array<struct<track_id: bigint, x1: double, y1: double, x2: double, y2: double, confidence: double, observed: boolean>>"
CACHE = f"frame_id bigint, event_time_s double, source_timestamp double, detections {BOX}, tracks {TRACK}, source_frame_shape array<int>, scheduler_decision struct<scan_type: string>"
ANNOTATION_FPS = 25.0
SEGMENT_GAP = 20


def read_points(spark: SparkSession, path: str, source: str, duration: float | None = None) -> DataFrame:
    """Points of one source up to a time; both filters reach the Parquet scan."""
    df = spark.read.schema(POINTS).parquet(path).filter(F.col("source") == source)
    return df if duration is None else df.filter(F.col("timestamp") <= duration)


def only_source(points: DataFrame) -> str:
    """The one source that the points have; mixing sources is an error."""
    found = [r["source"] for r in points.select("source").distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"points mix sources: {sorted(map(str, found))}")
    return found[0] if found else ""


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).csv(path, header=True, enforceSchema=False)


def track_lifetimes(points: DataFrame) -> DataFrame:
    return points.groupBy("camera_id", "track_id").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def read_annotations(spark: SparkSession, folder: str, duration: float | None = None) -> DataFrame:
    """One text file per pedestrian, tokens ``x y frame`` repeated: pedestrian_id, frame_id, x, y, annotation_file.

    A file whose name is no number, whose tokens are no triples, or that has values that are not
    finite, frames that are not whole or go backwards stops the read with an error.
    """
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    stem = F.regexp_extract("file", r"^(\d+)\.txt$", 1)
    tokens = F.filter(F.split("value", r"\s+"), lambda t: t != "")
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("file")))
    f = files.select("file", stem.alias("stem"), tokens.alias("t"))
    f = f.withColumn("t", F.when(F.col("stem") == "", wrong("name is no number").cast("array<string>")).when(F.size("t") % 3 != 0, wrong("tokens are no triples").cast("array<string>")).otherwise(F.col("t")))
    rows = f.filter(F.size("t") > 0).select("file", F.col("stem").cast("int").alias("pedestrian_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("t") - 3, F.lit(3)), lambda i: F.slice("t", i + 1, 3))).alias("pos", "p"))
    number = lambda k: F.expr(f"try_cast(p[{k}] AS double)")
    rows = rows.select("file", "pedestrian_id", "pos", number(0).alias("x"), number(1).alias("y"), number(2).alias("frame"))
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("frame").isNull() | F.isnan("x") | F.isnan("y") | (F.abs("x") == math.inf) | (F.abs("y") == math.inf) | (F.abs(F.col("frame") - F.rint("frame")) > 1e-6)
    back = F.col("frame") < F.lag("frame").over(Window.partitionBy("file").orderBy("pos"))
    rows = rows.withColumn("x", F.when(bad, wrong("bad value").cast("double")).when(F.coalesce(back, F.lit(False)), wrong("frames go backwards").cast("double")).otherwise(F.col("x")))
    rows = rows.select("pedestrian_id", F.rint("frame").cast("bigint").alias("frame_id"), "x", "y", F.col("file").alias("annotation_file"))
    return rows if duration is None else rows.filter(F.col("frame_id") <= math.floor(duration * ANNOTATION_FPS))


def numeric_stem(name: Column) -> Column:
    """Sort key of a file name: its number, names without one last."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)\.[^.]*$", 1), F.lit("")).cast("int"), F.lit(2147483647))


def annotation_points(rows: DataFrame, homography: list[list[float]] | None = None, zones: list | None = None, camera: str = "cam01") -> DataFrame:
    """Annotations as canonical ground-truth points; a frame gap above the bound starts a new track id."""
    w = Window.partitionBy("pedestrian_id").orderBy("frame_id")
    new = F.when(F.col("frame_id") - F.lag("frame_id").over(w) > SEGMENT_GAP, 1).otherwise(0)
    t = rows.withColumn("_new", new).withColumn("_seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.lit(None).cast("double")
    wx, wy = project(F.col("x"), F.col("y"), homography) if homography else (none, none)
    px, py = (wx, wy) if homography else (F.col("x"), F.col("y"))
    return t.select(
        F.lit(camera).alias("camera_id"), F.lit("ground_truth").alias("source"), "frame_id", (F.col("frame_id") / ANNOTATION_FPS).alias("timestamp"), (F.col("pedestrian_id").cast("bigint") * 100 + F.col("_seg")).alias("track_id"),
        "x", "y", *[none.alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("x").alias("foot_x"), F.col("y").alias("foot_y"), wx.alias("world_x"), wy.alias("world_y"), none.alias("confidence"),
        (zone_at(px, py, zones) if zones else F.lit(None).cast("string")).alias("zone_id"),
    )


def read_frame_cache(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per frame; the time may stand under either name. ``at`` tells where in the files a row stands."""
    df = spark.read.schema(CACHE).json(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return df.withColumn("event_time_s", F.coalesce("event_time_s", "source_timestamp")).drop("source_timestamp").withColumn("at", at)


def cache_order_errors(cache: DataFrame) -> DataFrame:
    """Frames whose number does not rise, or whose time goes back, from the row before them in their file.

    Rows are followed within the blocks that a file is read in; a block's first row follows the last one of the block before.
    """
    c = cache.select("frame_id", "event_time_s", "at.*")
    w = Window.partitionBy("file", "block").orderBy("line")
    row = F.struct("frame_id", "event_time_s")
    inside = c.withColumn("p", F.lag(row).over(w)).filter("p IS NOT NULL").select(row.alias("r"), "p")
    ends = c.groupBy("file", "block").agg(F.min_by(row, "line").alias("r"), F.max_by(row, "line").alias("last"))
    across = ends.withColumn("p", F.lag("last").over(Window.partitionBy("file").orderBy("block"))).filter("p IS NOT NULL").select("r", "p")
    return inside.unionByName(across).filter("r.frame_id <= p.frame_id OR r.event_time_s < p.event_time_s").select("r.*")


def write_frame_cache(tracks: DataFrame, path: str) -> None:
    """Frames as JSON lines, in order of their number, with their tracks; columns as ``cache_tracks`` gives them."""
    t = F.struct("track_id", "x1", "y1", "x2", "y2", "confidence", "observed")
    rows = tracks.groupBy("frame_id").agg(F.max("timestamp").alias("event_time_s"), F.array_sort(F.collect_list(t)).alias("tracks"))
    rows.repartitionByRange("frame_id").sortWithinPartitions("frame_id").write.mode("overwrite").json(path)


def pack_packets(frames: DataFrame, header: list[str], body: str = "body") -> DataFrame:
    """``packet``: the inverse of ``unpack_packets``, a header of the named columns in front of the body."""
    head = F.to_json(F.struct(*header)).cast("binary")
    size = F.unhex(F.lpad(F.hex(F.octet_length(head)), 8, "0"))
    return frames.withColumn("packet", F.concat(size, head, F.coalesce(F.col(body), F.lit(b""))))


def write_frame_metrics(metrics: DataFrame, path: str) -> None:
    """A CSV row for each frame, in order, numbers to six places."""
    kinds = dict(metrics.dtypes)
    rows = metrics.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in metrics.columns])
    rows.repartitionByRange("frame").sortWithinPartitions("frame").write.mode("overwrite").csv(path, header=True)


def artifact_problems(spark: SparkSession, folder: str, expected: list[str]) -> list[str]:
    """What is wrong with a folder of results: expected names that are missing or empty, and names that are not expected."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {f.getPath().getName(): fs.getContentSummary(f.getPath()).getLength() for f in (fs.listStatus(root) if fs.exists(root) else [])}
    wrong = [f"missing: {n}" for n in expected if n not in there] + [f"empty: {n}" for n in expected if there.get(n) == 0]
    return wrong + [f"unexpected: {n}" for n in sorted(there) if n not in expected and not n.startswith((".", "_"))]


def cache_tracks(cache: DataFrame) -> DataFrame:
    """A row per track and frame; a missing flag means observed, a missing confidence 0."""
    t = cache.select("frame_id", "event_time_s", F.explode("tracks").alias("t"))
    return t.select("frame_id", F.col("event_time_s").alias("timestamp"), "t.track_id", "t.x1", "t.y1", "t.x2", "t.y2", F.coalesce("t.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("t.observed", F.lit(True)).alias("observed"))


def cache_detections(cache: DataFrame) -> DataFrame:
    d = cache.select("frame_id", "event_time_s", F.posexplode("detections").alias("box_id", "d"))
    return d.select("frame_id", F.col("event_time_s").alias("timestamp"), "box_id", "d.x1", "d.y1", "d.x2", "d.y2", F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("d.class_id", F.lit(0)).alias("class_id"))


def aligned(frames: DataFrame, cache: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Frames with their cached row, and why there is none: missing frame, or times apart."""
    j = frames.select("frame_id", F.col("timestamp").alias("t")).join(cache, "frame_id", "left")
    why = F.when(F.col("event_time_s").isNull(), "FRAME_MISSING").when(F.abs(F.col("event_time_s") - F.col("t")) > tolerance, "TIME_MISMATCH")
    return j.withColumn("problem", why)


def read_zones(spark: SparkSession, path: str, width: float | None = None, height: float | None = None) -> list[tuple[str, list[tuple[float, float]]]]:
    """Zones of a JSON file in list order, scaled from its picture size to the given one. A dimension table: small by nature."""
    raw = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    sx = width / raw["image_width"] if width and raw.get("image_width") else 1.0
    sy = height / raw["image_height"] if height and raw.get("image_height") else 1.0
    out = []
    for z in raw["zones"]:
        name = z.get("zone_id") or z["id"]
        if len(z["points"]) < 3:
            raise ValueError(f"zone {name} has fewer than three points")
        out.append((name, [(x * sx, y * sy) for x, y in z["points"]]))
    if len({n for n, _ in out}) != len(out):
        raise ValueError("zone ids repeat")
    return out


def read_homography(spark: SparkSession, path: str) -> list[list[float]]:
    """A 3 x 3 matrix under ``matrix``, ``homog`` or alone; finite and invertible."""
    import numpy as np

    raw = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    m = np.array(raw.get("matrix", raw.get("homog")) if isinstance(raw, dict) else raw, float)
    if m.shape != (3, 3) or not np.isfinite(m).all() or abs(np.linalg.det(m)) <= 1e-12:
        raise ValueError("a finite, invertible 3 x 3 matrix is needed")
    return m.tolist()


def perspective(corners: list[tuple[float, float]], width: float, height: float) -> list[list[float]]:
    """The homography that takes four corners to the rectangle of a plane."""
    import numpy as np

    x, y = np.array(corners, float).T
    if not np.isfinite([x, y]).all() or abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2 < 1:
        raise ValueError("the corners span no area")
    rows, right = [], []
    for (a, b), (u, v) in zip(corners, [(0, 0), (width, 0), (width, height), (0, height)], strict=True):
        rows += [[a, b, 1, 0, 0, 0, -a * u, -b * u], [0, 0, 0, a, b, 1, -a * v, -b * v]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), right), 1.0).reshape(3, 3).tolist()


def unpack_packets(packets: DataFrame, column: str = "packet", schema: str = "frame_id bigint, event_time_s double", header_most: int = 65536, body_most: int = 1_800_000) -> DataFrame:
    """Live packets (four-byte big-endian header length, JSON header, body): header fields, body, and what is wrong."""
    p = F.col(column)
    size = F.conv(F.hex(F.substring(p, 1, 4)), 16, 10).cast("bigint")
    d = packets.withColumn("_n", F.when(F.length(p) >= 4, size))
    ok = F.col("_n").isNotNull() & (F.col("_n") <= header_most) & (F.length(p) >= F.col("_n") + 4) & (F.length(p) - F.col("_n") - 4 <= body_most)
    head = F.when(ok, F.from_json(F.expr(f"cast(substring({column}, 5, cast(_n AS int)) AS string)"), schema))
    body = F.when(ok, F.expr(f"substring({column}, cast(_n AS int) + 5)"))
    return d.withColumns({"header": head, "body": body, "problem": F.when(~F.coalesce(ok, F.lit(False)), "BAD_PACKET")}).drop("_n")


def write_points(points: DataFrame, path: str, csv: str | None = None) -> DataFrame:
    """Write canonical points; returns one row: rows, tracks, frames. No rows, or a null where a value is needed, is an error."""
    names = [f.split()[0] for f in POINTS.split(", ")]
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in NEEDED])
    report = points.agg(F.count("*").alias("rows"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("frame_id").alias("frames"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing"))
    r = report.first()
    if not r["rows"] or r["missing"]:
        raise ValueError("no points to write" if not r["rows"] else f"{r['missing']} points lack a needed value")
    points.select(*names).write.option("compression", "zstd").mode("overwrite").parquet(path)
    if csv:
        points.select(*[F.round(c, 6 if c == "timestamp" else 4).alias(c) if dict(points.dtypes)[c] == "double" else F.coalesce(F.col(c), F.lit("")).alias(c) if c == "zone_id" else F.col(c) for c in names]).write.mode("overwrite").csv(csv, header=True)
    return report.drop("missing")


def write_report(frame: DataFrame, path: str, **labels: str) -> None:
    """JSON rows with their labels (source, mode, duration) as partitions."""
    for k, v in labels.items():
        frame = frame.withColumn(k, F.lit(v))
    frame.write.mode("overwrite").partitionBy(*labels).json(path)


def changed_rows(timeline: DataFrame, signature: list[str], seconds: float = 1.0, key: tuple[str, ...] = ("camera_id", "stream_epoch")) -> DataFrame:
    """Rows whose signature differs from the row before, or in a new second of the clock."""
    w = Window.partitionBy(*key).orderBy("timestamp")
    sig = F.to_json(F.struct(*signature))
    t = timeline.withColumns({"_s": F.lag(sig).over(w), "_t": F.lag("timestamp").over(w)})
    keep = F.col("_t").isNull() | (F.col("_s") != sig) | (F.floor(F.col("timestamp") / seconds) != F.floor(F.col("_t") / seconds))
    return t.filter(keep).drop("_s", "_t")

