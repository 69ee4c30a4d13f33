"""Search parameters."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the method: seed and screening word length, screening frame.
SEED, SCREEN, FRAME = 21, 16, 6
MAX_LENGTH = 32_768


@dataclass(frozen=True)
class SearchParams:
    continuous_bases: int = 0
    covered_bases: int = 0
    max_diag_delta: int = 4
    coverage_ratio: float = 0.5
    per_mate: bool = False
    prescreen: bool = False

    def __post_init__(self) -> None:
        if min(self.continuous_bases, self.covered_bases, self.max_diag_delta) < 0:
            raise ValueError("thresholds must not be negative")
        if not 0 <= self.coverage_ratio <= 1:
            raise ValueError("coverage_ratio must lie in [0, 1]")
