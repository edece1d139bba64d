"""Parameters of the operators, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    window: int = 20
    entropy_window: int = 64
    entropy_low: float = 1.2
    entropy_high: float = 3.8
    draft_threshold: float = 0.90
    alpha: float = 0.10
    hallucination_cap: float = 0.50
    flag_seconds: int = 120
    max_hops: int = 8


DEFAULT = Config()
