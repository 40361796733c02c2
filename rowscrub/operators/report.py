"""What a step did and what it left out; column names only, never cell values."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

log = logging.getLogger("rowscrub")


@dataclass
class Report:
    """Collects one line per step. Pass one to any operator to see what it skipped."""

    steps: list[tuple[str, list[str], list[str]]] = field(default_factory=list)

    def add(self, step: str, done, skipped=()) -> None:
        done, skipped = list(done), list(skipped)
        self.steps.append((step, done, skipped))
        if skipped:
            log.warning("%s: skipped %s", step, skipped)

    def skipped(self, step: str) -> list[str]:
        return [name for s, _, names in self.steps if s == step for name in names]


def note(report: Report | None, step: str, done, skipped=()) -> None:
    if report is not None:
        report.add(step, done, skipped)
    elif skipped:
        log.warning("%s: skipped %s", step, list(skipped))
