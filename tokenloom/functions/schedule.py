"""Warm-up / stable / decay value as a column function of tokens seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    total_tokens: int
    peak: float = 1e-3
    floor: float = 1e-4
    warmup_fraction: float = 0.02
    decay_fraction: float = 0.1
    decay_mix: float = 0.1

    def __post_init__(self):
        if not 0 < self.warmup_fraction < 1 - self.decay_fraction < 1:
            raise ValueError("Warm-up, stable and decay phases must all be present")
        if not 0 <= self.decay_mix <= 1:
            raise ValueError("decay_mix must lie in [0, 1]")

    @property
    def warm_tokens(self) -> int:
        return max(1, int(self.total_tokens * self.warmup_fraction))

    @property
    def decay_start(self) -> int:
        return int(self.total_tokens * (1 - self.decay_fraction))


def phase(tokens: Column, s: Schedule) -> Column:
    return (
        F.when(tokens < s.warm_tokens, F.lit("warmup"))
        .when(tokens < s.decay_start, F.lit("stable"))
        .otherwise(F.lit("decay"))
    )


def rate(tokens: Column, s: Schedule) -> Column:
    """Linear rise to the peak, flat, then linear fall to the floor (clamped past the end)."""
    span = float(max(1, s.total_tokens - s.decay_start))
    done = F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), (tokens - s.decay_start).cast("double") / F.lit(span))
    )
    return (
        F.when(tokens < s.warm_tokens, F.lit(s.peak) * tokens / F.lit(float(s.warm_tokens)))
        .when(tokens < s.decay_start, F.lit(s.peak))
        .otherwise(F.lit(s.peak) + done * F.lit(s.floor - s.peak))
    )
