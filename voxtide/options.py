"""Option sets with their validity rules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

SAMPLE_RATE = 16_000
MS_PER_SECOND = 1_000


def _finite(name: str, value: float) -> None:
    if not math.isfinite(value):
        raise ValueError(f"{name} must be finite")


def _dbfs(name: str, value: float) -> None:
    _finite(name, value)
    if value > 0:
        raise ValueError(f"{name} cannot exceed full scale")


@dataclass(frozen=True)
class SegmenterOptions:
    """Timing rules of the hysteresis segmenter (sample counts at 16 kHz)."""

    onset_frames: int = 4
    silence_frames: int = 25
    pre_roll: int = 3_200
    post_roll: int = 3_200
    min_speech: int = 4_800
    merge_gap: int = 3_200
    max_segment: int = 400_000
    split_search: int = 16_000
    split_overlap: int = 0

    def __post_init__(self) -> None:
        if self.onset_frames <= 0 or self.silence_frames <= 0:
            raise ValueError("onset_frames and silence_frames must be at least one")
        for name in ("pre_roll", "post_roll", "min_speech", "merge_gap", "split_search"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} cannot be negative")
        if self.max_segment <= 0:
            raise ValueError("max_segment must be positive")
        if not 0 <= self.split_overlap < self.max_segment:
            raise ValueError("split_overlap must be non-negative and below max_segment")


@dataclass(frozen=True)
class DetectorOptions:
    """Energy thresholds of the detector; levels are in dBFS."""

    frame_samples: int = 320
    initial_floor: float = -60.0
    min_floor: float = -90.0
    max_floor: float = -20.0
    adaptation: float = 0.05
    on_margin: float = 12.0
    off_margin: float = 7.0
    min_on: float = -45.0
    min_off: float = -50.0
    segmenter: SegmenterOptions = field(default_factory=SegmenterOptions)

    def __post_init__(self) -> None:
        if self.frame_samples <= 0:
            raise ValueError("frame_samples must be positive")
        for name in ("initial_floor", "min_floor", "max_floor", "min_on", "min_off"):
            _dbfs(name, getattr(self, name))
        for name in ("adaptation", "on_margin", "off_margin"):
            _finite(name, getattr(self, name))
        if self.min_floor > self.max_floor:
            raise ValueError("min_floor cannot exceed max_floor")
        if not self.min_floor <= self.initial_floor <= self.max_floor:
            raise ValueError("initial_floor must lie within the floor bounds")
        if not 0.0 <= self.adaptation <= 1.0:
            raise ValueError("adaptation must be between zero and one")
        if self.on_margin <= self.off_margin:
            raise ValueError("on_margin must exceed off_margin")
        if self.min_on < self.min_off:
            raise ValueError("min_on must not be below min_off")

    @property
    def forced_piece_can_fail(self) -> bool:
        """Whether padding could reach back over an earlier interval far enough to empty a forced piece."""
        seg = self.segmenter
        return seg.pre_roll + seg.post_roll >= seg.silence_frames * self.frame_samples
