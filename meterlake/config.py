"""Settings of a lake and of its operators, as one immutable value."""

from __future__ import annotations

import ast
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

#: The vocabularies of the data contract.
OPERATING_MODES = ("RUNNING", "IDLE", "STANDBY", "BOOST", "MAINTENANCE", "OFF", "FAULT")
PRODUCTIVE_MODES = ("RUNNING", "BOOST")
DOWN_MODES = ("OFF", "FAULT", "MAINTENANCE")
EVENT_TYPES = ("Alarm", "Warning", "Fault", "Info")
SEVERITIES = ("Low", "Medium", "High")
#: Plausible ranges of the measures.
RANGES = {
    "temperature": (-40.0, 120.0),
    "humidity": (0.0, 100.0),
    "pressure": (0.0, 1200.0),
    "vibration": (0.0, 100.0),
    "power_consumption": (0.0, 5000.0),
}


@dataclass(frozen=True)
class Settings:
    """Every parameter with its default; :meth:`with_environment` overrides them by name."""

    root: str = "lake"
    format: str = "parquet"
    sampling_seconds: int = 300
    late_seconds: int = 86_400
    stale_minutes: float = 60.0
    outlier_score: float = 6.0
    anomaly_score: float = 2.0
    anomaly_percent: float = 10.0
    week_percent: float = 20.0
    baseline_days: int = 7
    least_baseline_days: int = 3
    least_coverage: float = 80.0
    silent_hours: float = 24.0
    fault_limit: int = 10
    fault_days: int = 30
    max_depth: int = 12
    watermark: str = "15 minutes"
    window: str = "5 minutes"
    fail_on_breach: bool = True
    retain_hours: int = 168
    quarantine_days: int = 30
    compact_files: int = 64
    thresholds: tuple[tuple[str, float], ...] = (("completeness", 0.05), ("uniqueness", 0.05), ("validity", 0.02), ("enum", 0.01), ("accuracy", 0.02), ("consistency", 0.02), ("site", 0.005), ("timeliness", 0.05))

    def threshold(self, name: str) -> float:
        return dict(self.thresholds)[name]

    def table(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"

    def with_environment(self, prefix: str = "METERLAKE__", environ: Mapping[str, str] = os.environ) -> Settings:
        """Override fields by ``<prefix><FIELD>`` variables; values are Python literals, else strings."""
        known, changes = {f.name.upper(): f.name for f in fields(self)}, {}
        for key, raw in environ.items():
            if key.startswith(prefix) and (name := known.get(key[len(prefix) :].upper())):
                value: Any
                try:
                    value = ast.literal_eval(raw)
                except (ValueError, SyntaxError):
                    value = raw
                changes[name] = value
        return replace(self, **changes)
