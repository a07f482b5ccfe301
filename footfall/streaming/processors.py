"""The state machines as stateful processors, and streaming forms of the relational operators.

State is keyed by session or by (session, track) and holds one pickled machine of bounded size. Rows
of a key are taken in event order within a micro-batch; rows behind what the key has seen are counted and
dropped. A new ``stream_epoch`` is a new key; idle keys can be dropped by a time-to-live.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footfall.config import Settings
from footfall.functions import tracks as K
from footfall.functions.geometry import grid_cell
from footfall.operators.stateful import ENGINES, PATHS, rows_of
from footfall.operators.steps import KEY


class _Kept(StatefulProcessor):
    """A machine in a value state, with the time up to which it has been fed.

    ``ttl_ms`` drops keys that long idle; it needs a continuously triggered query, as time-to-live
    runs on the processing clock.
    """

    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "blob binary, upto double, late bigint", self.ttl_ms)

    def close(self) -> None:
        pass

    def load(self, fresh):
        if not self.state.exists():
            return fresh(), float("-inf"), 0
        blob, upto, late = self.state.get()
        return pickle.loads(bytes(blob)), upto, late

    def save(self, machine, upto: float, late: int) -> None:
        self.state.update((pickle.dumps(machine), upto, late))

    @staticmethod
    def ordered(rows: Iterator[pd.DataFrame], upto: float) -> tuple[pd.DataFrame, int]:
        parts = list(rows)
        every = pd.concat(parts) if parts else pd.DataFrame()
        if every.empty:
            return every, 0
        every = every.sort_values(["timestamp", "frame_id"], kind="stable")
        on_time = every[every.timestamp > upto]
        return on_time, len(every) - len(on_time)


class ZoneProcessor(_Kept):
    """Debounced zone events of a track."""

    SCHEMA = "track_id bigint, kind string, zone_id string, timestamp double, value double"

    def __init__(self, s: Settings, zones: list):
        self.s, self.zones = s, zones

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walk, upto, late = self.load(lambda: K.ZoneWalk(self.s, self.zones))
        todo, missed = self.ordered(rows, upto)
        out = [(key[2], *e) for r in todo.itertuples() for e in walk.feed(r.timestamp, r.x, r.y)]
        self.save(walk, float(todo.timestamp.max()) if len(todo) else upto, late + missed)
        yield pd.DataFrame(out, columns=["track_id", "kind", "zone_id", "timestamp", "value"])


class SmoothProcessor(_Kept):
    """Accepted points of the trajectory manager."""

    SCHEMA = "track_id bigint, frame_id bigint, timestamp double, x double, y double, accepted int, confirmed boolean"

    def __init__(self, s: Settings):
        self.s = s

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        track, upto, late = self.load(lambda: K.Trajectory(self.s))
        todo, missed = self.ordered(rows, upto)
        out = []
        for r in todo.itertuples():
            p = track.feed(r.timestamp, r.frame_id, r.x, r.y)
            if p:
                out.append((key[2], p[1], p[0], p[2], p[3], track.accepted, track.confirmed))
        self.save(track, float(todo.timestamp.max()) if len(todo) else upto, late + missed)
        yield pd.DataFrame(out, columns=["track_id", "frame_id", "timestamp", "x", "y", "accepted", "confirmed"])


class PathProcessor(_Kept):
    """A common-path engine of a session: a row per shown path whenever names or states change."""

    SCHEMA = PATHS

    def __init__(self, s: Settings, engine: str, make=None):
        self.s, self.make = s, make or ENGINES[engine]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        engine, upto, late = self.load(lambda: self.make(self.s))
        todo, missed = self.ordered(rows, upto)
        out, last = [], [(p.path_id, p.state) for p in engine.paths]
        for now, g in todo.groupby("timestamp", sort=True):
            shown = engine.feed(now, [(r.track_id, 0, int(r.frame_id), r.x, r.y) for r in g.sort_values("track_id").itertuples()])
            names = [(p.path_id, p.state) for p in shown]
            if names != last:
                out += rows_of(key[0], key[1], float(now), shown)
            last = names
        self.save(engine, float(todo.timestamp.max()) if len(todo) else upto, late + missed)
        cols = ["camera_id", "stream_epoch", "timestamp", "path_id", "state", "support_short", "support_long", "score", "direction", "revision", "line"]
        yield pd.DataFrame(out, columns=cols)


def _run(points: DataFrame, keys: tuple[str, ...], processor: _Kept, ttl_ms: int | None) -> DataFrame:
    processor.ttl_ms = ttl_ms
    return points.groupBy(*keys).transformWithStateInPandas(processor, processor.SCHEMA, "Append", "ProcessingTime" if ttl_ms else "None")


def zone_events(points: DataFrame, s: Settings, zones: list, ttl_ms: int | None = None) -> DataFrame:
    return _run(points, KEY, ZoneProcessor(s, zones), ttl_ms)


def smoothed(points: DataFrame, s: Settings, ttl_ms: int | None = None) -> DataFrame:
    return _run(points, KEY, SmoothProcessor(s), ttl_ms)


def common_paths(points: DataFrame, s: Settings, engine: str, make=None, ttl_ms: int | None = None) -> DataFrame:
    return _run(points, KEY[:2], PathProcessor(s, engine, make), ttl_ms)


#: Event times start a day after the epoch, as a stream's first watermark is the epoch itself.
DAY = 86400


def deduplicated(points: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Points with event time ``ts``, each (session, track, frame) once within the watermark."""
    timed = points.withColumn("ts", F.timestamp_micros(((F.col("timestamp") + DAY) * 1_000_000).cast("bigint")))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*KEY, "frame_id"])


def crowd_timeline(points: DataFrame, s: Settings, every: str = "1 second") -> DataFrame:
    """Observations and distinct cells in use per tumbling window, by watermark."""
    cell = grid_cell(F.col("x"), F.col("y"), s.width, s.height, s.grid_width, s.grid_height)
    w = deduplicated(points).withColumn("cell", cell).groupBy(F.window("ts", every), "camera_id").agg(F.count("*").alias("observations"), F.approx_count_distinct("track_id").alias("people"), F.approx_count_distinct("cell").alias("cells"))
    return w.select((F.unix_seconds("window.start") - DAY).alias("second"), "camera_id", "observations", "people", "cells")


def cell_counts(points: DataFrame, s: Settings, span: str = "10 seconds", slide: str = "1 second") -> DataFrame:
    """Observations per cell over a sliding window."""
    cell = grid_cell(F.col("x"), F.col("y"), s.width, s.height, s.grid_width, s.grid_height)
    w = deduplicated(points).withColumn("cell", cell).filter("cell is not null")
    return w.groupBy(F.window("ts", span, slide), "cell.row", "cell.col").agg(F.count("*").alias("observations")).select((F.unix_seconds("window.end") - DAY).alias("second"), "row", "col", "observations")


def visits(points: DataFrame, idle: str = "15 seconds") -> DataFrame:
    """Stays of each track as session windows that an idle time ends."""
    w = deduplicated(points).groupBy(F.session_window("ts", idle), *KEY).agg(F.count("*").alias("points"))
    return w.select(*KEY, (F.unix_micros("session_window.start") - DAY * 1_000_000).alias("start_us"), (F.unix_micros("session_window.end") - DAY * 1_000_000).alias("end_us"), "points")
