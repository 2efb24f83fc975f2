"""Behavioural parameters, as literals that plan builders take; never session settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Fixed values that results depend on.
    match_score: float = 0.2
    matches_per_pair: int = 100
    feature_score: float = 0.05
    features_per_image: int = 1024
    neighbours: int = 8
    memory_limit_bytes: int = 16 << 30
    rectified_side: int = 4096
    inference_width: int = 1024
    inference_height: int = 1024
    focal35_default: float = 28.0
    huber_delta: float = 1.0
    solver_iterations: int = 1000


DEFAULT = Config()
