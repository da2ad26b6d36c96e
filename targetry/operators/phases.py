"""Wall time, rows and jobs by phase, observed by the jobs that do the work."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Phase:
    seconds: float = 0.0
    jobs: int = 0
    facts: dict[str, int] = field(default_factory=dict)


class Phases:
    """Phases in the order they first began; what a phase does again is added to it."""

    def __init__(self, spark: SparkSession):
        self.context, self.found = spark.sparkContext, {}

    @contextmanager
    def phase(self, name: str) -> Iterator[Phase]:
        own = self.found.setdefault(name, Phase())
        tracker = self.context.statusTracker()
        group, began = self.context.getLocalProperty("spark.jobGroup.id"), time.time()
        before = len(tracker.getJobIdsForGroup(group))
        try:
            yield own
        finally:
            own.seconds += time.time() - began
            own.jobs += len(tracker.getJobIdsForGroup(group)) - before

    def add(self, name: str, **facts: int | None) -> None:
        """Adds up counts of a phase."""
        own = self.found.setdefault(name, Phase()).facts
        for k, v in facts.items():
            own[k] = own.get(k, 0) + (v or 0)

    def report(self) -> dict[str, dict[str, float]]:
        return {k: {"seconds": round(p.seconds, 3), "jobs": p.jobs, **p.facts} for k, p in self.found.items()}
