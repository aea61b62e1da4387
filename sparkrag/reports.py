"""Audit reports: what was run, on what, and what came of it."""

from __future__ import annotations

import json
import os
import platform
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from . import __version__
from .config import ExperimentProfile
from .operators.evaluate import wide_report


@dataclass(frozen=True)
class SystemInfo:
    python_version: str
    library_version: str
    platform: str
    cpu_count: int
    ram_gb: float
    gpu: str | None = None

    @classmethod
    def here(cls) -> SystemInfo:
        ram = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30 if hasattr(os, "sysconf") else 1.0
        return cls(platform.python_version(), __version__, platform.platform(), os.cpu_count() or 1, round(ram, 2))


@dataclass(frozen=True)
class AuditReport:
    profile_hash: str
    duration_seconds: float
    metrics: dict[str, float]
    system: SystemInfo = field(default_factory=SystemInfo.here)
    report_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def __post_init__(self):
        if self.duration_seconds < 0:
            raise ValueError("a duration must not be negative")

    @classmethod
    def of(cls, profile: ExperimentProfile, means: DataFrame, duration_seconds: float) -> AuditReport:
        """A report of the means of a run: a few rows, one for each metric."""
        return cls(profile.compute_hash(), duration_seconds, {r.metric: r.value for r in means.collect()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True, ensure_ascii=False)

    @staticmethod
    def to_dataframe(results: DataFrame, values: DataFrame, metrics: list[str]) -> DataFrame:
        """One row for each case, with its metrics as columns; cases stay distributed."""
        return wide_report(results, values, metrics)
