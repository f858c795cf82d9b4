"""The analysis knobs, validated once on the driver and used as literals."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass

# Fixed values of the analysis (not knobs).
PADDING_DAYS = 90
CONFIRMED_DAYS = 42
WITHDRAWAL_FLOOR_DAYS = 42
DAYS_PER_MONTH = 30
DRIFT_SENSITIVITY_PTS = 2.0
SQFT_SUSPECT_SHARE = 0.30
GUARD_RANGE = 0.03
GUARD_MINIMUM = 3
EARTH_RADIUS_MI = 3958.7613
MONTHLY_CALLS = 50
GO_THRESHOLD = 15
DOMINANT_SHARE = 0.4
WIDE_RADIUS_MI = 25.0
PIPELINE_VERSION = "leasegrain-1"

_RANGES = {
    "stitch_gap_days": (7, 60),
    "provisional_lease_days": (3, 21),
    "withdrawal_suspect_months": (2, 10),
    "knn_k": (3, 15),
    "bucket_half_width_pct": (2.0, 10.0),
    "min_cohort_size": (2, 10),
}
_DRIFT_SOURCES = ("zip", "cohort", "manual")


class KnobError(ValueError):
    """A knob is unknown or outside its range; nothing is clamped."""


@dataclass(frozen=True)
class Knobs:
    stitch_gap_days: int = 42
    provisional_lease_days: int = 7
    withdrawal_suspect_months: int = 6
    knn_k: int = 7
    bucket_half_width_pct: float = 4.0
    min_cohort_size: int = 4
    drift_source: str = "manual"
    km_horizons_days: tuple[int, ...] = (14, 30, 45, 60)

    def __post_init__(self) -> None:
        for name, (low, high) in _RANGES.items():
            value = getattr(self, name)
            whole = isinstance(low, int)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise KnobError(f"{name} must be a number, got {value!r}")
            if whole and value != int(value):
                raise KnobError(f"{name} must be a whole number, got {value!r}")
            if not low <= value <= high:
                raise KnobError(f"{name} must lie in [{low}, {high}], got {value!r}")
        if self.drift_source not in _DRIFT_SOURCES:
            raise KnobError(f"drift_source must be one of {_DRIFT_SOURCES}, got {self.drift_source!r}")
        days = tuple(self.km_horizons_days)
        object.__setattr__(self, "km_horizons_days", days)
        if not days or any(isinstance(d, bool) or not isinstance(d, int) or d <= 0 for d in days):
            raise KnobError("km_horizons_days must be a non-empty list of positive whole days")
        if list(days) != sorted(set(days)):
            raise KnobError("km_horizons_days must be strictly increasing")

    @classmethod
    def from_mapping(cls, payload: dict) -> "Knobs":
        """Missing keys take their defaults; unknown keys are errors."""
        if not isinstance(payload, dict):
            raise KnobError("knobs must be a JSON object")
        known = {field.name for field in dataclasses.fields(cls)}
        unknown = sorted(set(payload) - known)
        if unknown:
            raise KnobError(f"unknown knobs: {', '.join(unknown)}")
        values = dict(payload)
        if "km_horizons_days" in values:
            if not isinstance(values["km_horizons_days"], (list, tuple)):
                raise KnobError("km_horizons_days must be a list")
            values["km_horizons_days"] = tuple(values["km_horizons_days"])
        return cls(**values)

    def to_mapping(self) -> dict:
        values = dataclasses.asdict(self)
        values["km_horizons_days"] = list(self.km_horizons_days)
        return values

    def digest(self) -> str:
        canonical = json.dumps(self.to_mapping(), sort_keys=True)
        return hashlib.sha256(canonical.encode()).hexdigest()
