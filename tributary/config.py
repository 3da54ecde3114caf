"""Thresholds of a run, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Decision thresholds.
    auto_apply: float = 0.90
    min_map: float = 0.70
    ambiguous_delta: float = 0.08
    max_attempts: int = 3
    top_surfaces: int = 8
    top_fields: int = 4
    top_lookup: int = 3
    sample_size: int = 5


DEFAULT = Settings()
