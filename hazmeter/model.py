"""Closed sets of names, run options and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import StrEnum


class Metric(StrEnum):
    CYCLOMATIC = "cyclomatic"
    COGNITIVE = "cognitive"


class Missing(StrEnum):
    PESSIMISTIC = "pessimistic"
    OPTIMISTIC = "optimistic"
    SKIP = "skip"


class Risk(StrEnum):
    LOW = "low"
    ACCEPTABLE = "acceptable"
    MODERATE = "moderate"
    HIGH = "high"


class Format(StrEnum):
    TEXT = "text"
    JSON = "json"


class HazardError(Exception):
    """One unreadable or invalid source fails the whole run."""


class CoverageError(HazardError):
    pass


class CollectError(HazardError):
    pass


class ResolveError(HazardError):
    pass


DEFAULT_THRESHOLD = 15.0
NAMED_THRESHOLDS = {"strict": 8.0, "lenient": 25.0}


def parse_threshold(text: str) -> float:
    """``strict``, ``lenient`` or a finite number of zero or more."""
    if text in NAMED_THRESHOLDS:
        return NAMED_THRESHOLDS[text]
    try:
        value = float(text) if "_" not in text and text == text.strip() else math.nan
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"invalid threshold {text!r}: expected strict, lenient or a number of zero or more")
    return value


@dataclass(frozen=True)
class ScanRequest:
    path: str = "."
    coverage: str = "lcov.info"
    metric: Metric = Metric.CYCLOMATIC
    threshold: float | None = None
    summary: bool = False
    fail_above: bool = False
    missing: Missing = Missing.PESSIMISTIC
    format: Format = Format.TEXT
    #: Output of ``cargo metadata`` in place of the manifests.
    metadata: str | None = None

    @property
    def limit(self) -> float:
        return DEFAULT_THRESHOLD if self.threshold is None else self.threshold
