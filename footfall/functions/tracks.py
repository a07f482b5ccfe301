"""Per-track state machines: plain Python objects that take one observation at a time.

They serve batch (one ordered track at a time, grouped map) and streams (pickled as keyed state)
alike, so that the same rows give the same answer in both.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

from footfall.config import Settings

#: Steps below this length are smoothed twice as hard.
JITTER = 3.5


def inside(point: tuple[float, float], polygon: list[tuple[float, float]]) -> bool:
    """Whether a point lies in a polygon or on its edge."""
    x, y = point
    odd = False
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if abs(turn) <= 1e-9 * max(1.0, abs(bx - ax), abs(by - ay)) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def zone_of(point: tuple[float, float], zones: list) -> str | None:
    return next((name for name, polygon in zones if inside(point, polygon)), None)


def _eased(s: Settings, old: tuple[float, float], new: tuple[float, float]) -> tuple[float, float]:
    """Exponential smoothing; a jump beyond the bound counts as standing still."""
    step = math.dist(old, new)
    if step > s.max_movement_step:
        new, step = old, 0.0
    a = s.smoothing_alpha * (0.5 if step < JITTER else 1.0)
    return a * new[0] + (1 - a) * old[0], a * new[1] + (1 - a) * old[1]


@dataclass
class Debounce:
    """A zone that changes only after ``least`` observations in a row agree on the new one (outside counts as one)."""

    least: int
    stable: str | None = None
    candidate: str | None = None
    count: int = 0

    def feed(self, seen: str | None) -> bool:
        if seen == self.stable:
            self.candidate, self.count = None, 0
            return False
        self.count = self.count + 1 if seen == self.candidate and self.count else 1
        self.candidate = seen
        if self.count < self.least:
            return False
        self.stable, self.candidate, self.count = seen, None, 0
        return True


@dataclass
class Trajectory:
    """Smooths against the last accepted point; keeps a bounded history."""

    s: Settings
    points: deque = field(default_factory=deque)  # (timestamp, frame, x, y)
    age: int = 0
    accepted: int = 0
    last: float = -math.inf

    def feed(self, t: float, frame: int, x: float, y: float) -> tuple | None:
        """The accepted point, or None if it lies too close to the last one."""
        if self.points and t - self.last > self.s.inactive_track_ttl_seconds:
            self.points.clear()
            self.age = self.accepted = 0
        if self.points:
            x, y = _eased(self.s, self.points[-1][2:], (x, y))
        self.age += 1
        self.last = t
        if self.points and math.dist((x, y), self.points[-1][2:]) < self.s.min_point_distance:
            return None
        point = (t, frame, x, y)
        self.points.append(point)
        self.accepted += 1
        while len(self.points) > self.s.history_points or (len(self.points) > 1 and self.points[0][0] < t - self.s.max_history_seconds):
            self.points.popleft()
        return point

    @property
    def confirmed(self) -> bool:
        return self.accepted >= self.s.min_confirmed_points


@dataclass
class HeadingRules:
    """Limits of the direction estimate: seconds, observations, pixels, and pixels a second."""

    history: float = 1.0
    gap: float = 0.5
    observations: int = 3
    span: float = 0.15
    least_move: float = 2.0
    stop: float = 4.0
    start: float = 6.0


@dataclass
class Heading:
    """Where a track is heading, by its observations of the last second; it stops at one speed and starts at a higher one."""

    rules: HeadingRules = field(default_factory=HeadingRules)
    seen: deque = field(default_factory=deque)  # (timestamp, x, y)
    moving: bool = False

    def feed(self, t: float, x: float, y: float) -> tuple[str, float | None, float | None, float, float]:
        """State, unit vector, quality and observed span. A gap or a step back in time starts afresh, but for the state."""
        r = self.rules
        if self.seen and not 0 < t - self.seen[-1][0] <= r.gap:
            self.seen.clear()
        self.seen.append((t, x, y))
        while len(self.seen) > 1 and self.seen[0][0] < t - r.history:
            self.seen.popleft()
        span, dx, dy = t - self.seen[0][0], x - self.seen[0][1], y - self.seen[0][2]
        if len(self.seen) < r.observations or span < r.span:
            self.moving = False
            return "unknown", None, None, 0.0, span if len(self.seen) >= r.observations else 0.0
        move = math.hypot(dx, dy)
        self.moving = move / span > r.stop if self.moving else move / span >= r.start
        quality = min(1.0, len(self.seen) / (r.observations + 2)) * min(1.0, span / r.history)
        to = (dx / move, dy / move) if self.moving and move >= r.least_move else (None, None)
        return "moving" if self.moving else "stationary", *to, quality, span


@dataclass
class PointTracklet:
    """Smooths against a running estimate that moves with every observation; history and zone ends until idle."""

    s: Settings
    zones: list
    here: tuple[float, float] | None = None
    history: deque = field(default_factory=deque)  # (timestamp, frame, x, y, zone)
    accepted: int = 0
    confirmed: bool = False
    last_frame: int | None = None
    first_zone: str | None = None
    last_zone: str | None = None
    zone: Debounce | None = None

    def __post_init__(self) -> None:
        self.zone = self.zone or Debounce(self.s.zone_debounce_points)

    def idle(self, frame: int) -> bool:
        return self.last_frame is not None and frame - self.last_frame > self.s.track_buffer_frames

    def feed(self, t: float, frame: int, x: float, y: float) -> list[tuple]:
        """Points to keep: none until confirmed, then the whole history, then each accepted one."""
        self.last_frame = frame
        self.here = (x, y) if self.here is None else _eased(self.s, self.here, (x, y))
        if self.zone.feed(zone_of(self.here, self.zones)) and self.zone.stable is not None:
            self.first_zone = self.first_zone or self.zone.stable
            self.last_zone = self.zone.stable
        if self.history:
            old = self.history[-1][2:4]
            step = math.dist(self.here, old)
            if step > self.s.max_movement_step:
                self.here = old
                return []
            if step < self.s.movement_threshold:
                return []
        self.history.append((t, frame, *self.here, self.zone.stable))
        if len(self.history) > self.s.history_points:
            self.history.popleft()
        self.accepted += 1
        if self.confirmed:
            return [self.history[-1]]
        self.confirmed = self.accepted >= self.s.min_confirmed_points
        return list(self.history) if self.confirmed else []

    def transition(self) -> tuple[str, str] | None:
        if self.confirmed and self.first_zone and self.last_zone and self.first_zone != self.last_zone:
            return self.first_zone, self.last_zone
        return None


@dataclass
class ZoneWalk:
    """Debounced visits of one track: events (kind, zone, timestamp, value)."""

    s: Settings
    zones: list
    zone: Debounce | None = None
    since: float | None = None
    last: float | None = None
    came_from: str | None = None
    seen: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.zone = self.zone or Debounce(self.s.zone_debounce_points)

    def feed(self, t: float, x: float, y: float) -> list[tuple]:
        out = self.leave(t) if self.last is not None and t - self.last > self.s.inactive_track_ttl_seconds else []
        self.last = t
        old = self.zone.stable
        if self.zone.feed(zone_of((x, y), self.zones)):
            out += self._moved(old, self.zone.stable, t)
        return out

    def leave(self, now: float) -> list[tuple]:
        """What follows from the track's being idle at ``now``: an exit at its last sight, and a fresh start."""
        if self.last is None or now - self.last <= self.s.inactive_track_ttl_seconds:
            return []
        out = self._moved(self.zone.stable, None, self.last) if self.zone.stable else []
        self.zone, self.since, self.came_from = Debounce(self.s.zone_debounce_points), None, None
        return out

    def _moved(self, old: str | None, new: str | None, t: float) -> list[tuple]:
        out = []
        if old is not None:
            out.append(("exit", old, t, max(0.0, t - self.since) if self.since is not None else 0.0))
        if new is not None:
            out.append(("entry", new, t, 0.0))
            if self.came_from and self.came_from != new and (self.came_from, new) not in self.seen:
                self.seen.add((self.came_from, new))
                out.append(("flow", f"{self.came_from}>{new}", t, 0.0))
            self.came_from, self.since = new, t
        else:
            self.since = None
        return out
