"""Settings of the jobs, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectConfig:
    tile: int = 1280
    overlap: float = 0.2
    confidence: float = 0.4
    tile_iou: float = 0.5
    iou: float = 0.5
    min_area: float = 1.0
    #: Added to contour vertices before the affine transform.
    pixel_offset: float = 0.5


@dataclass(frozen=True)
class ExportConfig:
    crs: str = "EPSG:32635"
    height: str = "max"


@dataclass(frozen=True)
class GridConfig:
    side: float = 30.0
    squares: int = 3
    seed: int = 42
    max_empty: float = 0.5
    tries: int = 2000


@dataclass(frozen=True)
class MatchConfig:
    iou: float = 0.5

    def __post_init__(self):
        if self.iou <= 0:
            raise ValueError("the IoU threshold must be above 0: pairs that don't touch are no candidates")


@dataclass(frozen=True)
class SweepConfig:
    thresholds: tuple[float, ...] = (0.25, 0.30, 0.40, 0.50, 0.60)
    iou: float = 0.5
    min_area: float = 1.0
