"""Summaries of stage timings and queue samples, and what back-pressure there was."""

from __future__ import annotations

import json
import time
from collections import defaultdict, deque
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StreamingMetricsConfig

# Names of the stages of a pipeline.
STAGES = ("parsing", "chunking", "qa_generation", "indexing", "retrieval", "generation")


def stage_summary(timings: DataFrame, stage: str = "stage", elapsed: str = "elapsed_ms") -> DataFrame:
    """stage, count, total_ms, avg_ms, min_ms, max_ms."""
    e = F.col(elapsed)
    return timings.groupBy(stage).agg(F.count("*").alias("count"), F.sum(e).alias("total_ms"), F.avg(e).alias("avg_ms"), F.min(e).alias("min_ms"), F.max(e).alias("max_ms"))


def queue_summary(samples: DataFrame, maxsize: int, threshold: float = 0.8, size: str = "queue_size") -> DataFrame:
    """One row; back-pressure is a sample above maxsize * threshold."""
    s = F.col(size)
    return samples.agg(F.count("*").alias("total_samples"), F.avg(s).alias("avg_queue_size"), F.max(s).alias("max_queue_size"), F.min(s).alias("min_queue_size"), F.count_if(s > maxsize * threshold).alias("backpressure_events"))


def backpressure(samples: DataFrame, maxsize: int, threshold: float = 0.8, size: str = "queue_size") -> DataFrame:
    return samples.where(F.col(size) > maxsize * threshold)


def last_samples(samples: DataFrame, n: int, order: str = "sample_no") -> DataFrame:
    """The last n samples, by a distributed top-k."""
    return samples.orderBy(F.desc(order)).limit(n)


class StageTimer:
    """Times stages on the driver; use around actions."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.times = enabled, defaultdict(list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            if self.enabled:
                self.record(name, (time.perf_counter() - began) * 1000)

    def record(self, name: str, elapsed_ms: float) -> None:
        if elapsed_ms < 0:
            raise ValueError("elapsed time must not be negative")
        self.times[name].append(elapsed_ms)

    def summary(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(v), "total_ms": sum(v), "avg_ms": sum(v) / len(v), "min_ms": min(v), "max_ms": max(v)} for k, v in self.times.items() if v}


class Monitors:
    """Context managers entered together; if one fails to start, those before it are left again."""

    def __init__(self, *parts):
        self.parts, self._stack = parts, None

    def __enter__(self):
        with ExitStack() as stack:
            for p in self.parts:
                stack.enter_context(p)
            self._stack = stack.pop_all()
        return self

    def __exit__(self, *why):
        return self._stack.__exit__(*why)


class QueueMonitor:
    """Samples of a queue's size, the last ``max_samples`` of them."""

    def __init__(self, maxsize: int, config: StreamingMetricsConfig | None = None):
        self.maxsize, self.config, self.sizes = maxsize, config or StreamingMetricsConfig(), deque()

    def configure(self, **changes) -> QueueMonitor:
        """Change settings, which are checked as in a profile; samples that no longer fit are dropped."""
        self.config = replace(self.config, **changes)
        while len(self.sizes) > self.config.max_samples:
            self.sizes.popleft()
        return self

    def record(self, size: int) -> None:
        if self.config.enabled:
            self.sizes.append(size)
            self.configure()

    def summary(self) -> dict[str, float]:
        if not self.sizes:
            return {}
        n = len(self.sizes)
        high = sum(x > self.maxsize * self.config.backpressure_threshold for x in self.sizes)
        return {"total_samples": n, "avg_queue_size": sum(self.sizes) / n, "max_queue_size": max(self.sizes), "min_queue_size": min(self.sizes), "backpressure_events": high}

    def __enter__(self):
        return self

    def __exit__(self, *why) -> None:
        pass


def combined_summary(stages: StageTimer | None = None, queue: QueueMonitor | None = None) -> dict[str, dict]:
    """What is known of a run: "monitoring" by stage and "streaming" of the queue, each only if it is there."""
    return {k: x.summary() for k, x in (("monitoring", stages), ("streaming", queue)) if x is not None}


def _stamp(when: datetime | None) -> str:
    when = when or datetime.now(UTC)
    return (when if when.tzinfo else when.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")


def export_summary(timer: StageTimer, folder: str, prefix: str = "monitoring", when: datetime | None = None) -> str | None:
    if not timer.enabled:
        return None
    return _dump(Path(folder) / f"{prefix}_{_stamp(when)}.json", timer.summary())


def export_report(report: dict, folder: str, prefix: str = "evaluation", when: datetime | None = None) -> str:
    return _dump(Path(folder) / f"{prefix}_{report['report_id']}_{_stamp(when)}.json", report)


def _dump(path: Path, data: dict) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False, default=str), encoding="utf-8")
    return str(path)
