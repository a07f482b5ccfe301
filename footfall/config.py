"""Settings of the analytics operators, and layered YAML files."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Plane, grids, gates and windows; lengths in plane units, times in seconds."""

    width: float = 200.0
    height: float = 100.0
    grid_width: int = 20
    grid_height: int = 10
    path_grid_width: int = 8
    path_grid_height: int = 5
    max_point_gap_seconds: float = 2.0
    inactive_track_ttl_seconds: float = 15.0
    movement_threshold: float = 2.0
    max_movement_step: float = 80.0
    current_window_seconds: float = 10.0
    live_retention_seconds: float = 300.0
    min_confirmed_points: int = 3
    max_route_cells: int = 32
    zone_debounce_points: int = 2
    smoothing_alpha: float = 0.18
    min_point_distance: float = 0.0
    history_points: int = 150
    max_history_seconds: float = 30.0
    track_buffer_frames: int = 90
    fps: float = 25.0

    def __post_init__(self) -> None:
        for name in ("width", "height", "grid_width", "grid_height", "path_grid_width", "path_grid_height", "max_point_gap_seconds", "inactive_track_ttl_seconds", "fps"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.max_movement_step < self.movement_threshold:
            raise ValueError("max_movement_step must reach movement_threshold")
        if self.current_window_seconds > self.live_retention_seconds:
            raise ValueError("current_window_seconds must lie within live_retention_seconds")
        if not 0 < self.smoothing_alpha <= 1:
            raise ValueError("smoothing_alpha must lie in (0, 1]")

    def but(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, values: dict) -> Settings:
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)


def load_layers(path: str | Path, _open: tuple[Path, ...] = ()) -> dict:
    """A YAML mapping, laid over the files it names under ``extends`` (relative to itself)."""
    import yaml

    path = Path(path).resolve()
    if path in _open:
        raise ValueError("extends runs in a circle: " + " -> ".join(p.name for p in (*_open, path)))
    values = yaml.safe_load(path.read_text()) or {}
    if not isinstance(values, dict):
        raise ValueError(f"{path.name}: a mapping is needed")
    base = values.pop("extends", None)
    return _overlaid(load_layers(path.parent / base, (*_open, path)), values) if base else values


def _overlaid(under: dict, over: dict) -> dict:
    return {**under, **{k: _overlaid(under[k], v) if isinstance(v, dict) and isinstance(under.get(k), dict) else v for k, v in over.items()}}


def flatten(value, prefix: str = "") -> dict:
    """A nested mapping's leaves by dotted key."""
    if not isinstance(value, dict):
        return {prefix: value}
    return {k: v for key, inner in value.items() for k, v in flatten(inner, f"{prefix}.{key}" if prefix else str(key)).items()}
