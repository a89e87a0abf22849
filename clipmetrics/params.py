"""Operator settings: frozen, checked on construction, passed as values (never read on executors)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at_least(owner: object, **bounds: float) -> None:
    for name, low in bounds.items():
        if getattr(owner, name) < low:
            raise ValueError(f"{type(owner).__name__}.{name} must be at least {low}")


@dataclass(frozen=True)
class SearchFilters:
    """0 switches a condition off."""

    min_views: int = 0
    min_likes: int = 0
    max_duration_sec: int = 0
    published_within_days: int = 0

    def __post_init__(self) -> None:
        _at_least(self, min_views=0, min_likes=0, max_duration_sec=0, published_within_days=0)


@dataclass(frozen=True)
class CaptionParams:
    """Segmentation, consensus and refinement settings of the caption operators."""

    interval: float = 1.0 / 3.0
    max_gap: float | None = None
    text_similarity: float = 0.78
    consensus_similarity: float = 0.72
    min_confidence: float = 0.65
    min_chars: int = 2
    min_duration: float = 0.35
    persistent_seconds: float = 12.0
    persistent_observations: int = 4
    refine_confidence: float = 0.72
    refine_consensus: float = 0.67
    refine_observations: int = 2
    refine_per_video: int = 16
    refine_samples: int = 3
    refine_min_confidence: float = 0.50
    bottom_threshold: float = 0.68
    slice_seconds: float = 600.0

    def __post_init__(self) -> None:
        _at_least(self, interval=1e-6, text_similarity=0, consensus_similarity=0, min_confidence=0, min_chars=1,
                  min_duration=0.05, persistent_seconds=0, refine_observations=1, refine_per_video=1,
                  refine_samples=1, slice_seconds=1e-6)
        if self.max_gap is not None and self.max_gap < 0.05:
            raise ValueError("CaptionParams.max_gap must be at least 0.05")

    @property
    def gap(self) -> float:
        return self.max_gap if self.max_gap is not None else max(0.75, self.interval * 2.6)

    @property
    def retry_confidence(self) -> float:
        return min(self.min_confidence, max(0.50, self.min_confidence - 0.08))


@dataclass(frozen=True)
class PackingParams:
    """Speech grouping, long-text splitting and translation batch settings."""

    max_chars: int = 180
    max_duration: float = 10.0
    max_gap: float = 1.2
    split_chars: int = 90
    batch_size: int = 10
    context: int = 3

    def __post_init__(self) -> None:
        _at_least(self, max_chars=40, max_duration=2, max_gap=0, split_chars=1, batch_size=1, context=0)


@dataclass(frozen=True)
class MatchParams:
    """Cue to segment matching."""

    max_gap: float = 1.5
    bottom_threshold: float = 0.68
    min_bottom_width: float = 0.24
    min_bottom_height: float = 0.050
    bucket_seconds: float = 10.0

    def __post_init__(self) -> None:
        _at_least(self, max_gap=0, min_bottom_width=0.02, min_bottom_height=0.02, bucket_seconds=1e-6)


@dataclass(frozen=True)
class PersistentParams:
    """Persistent region vote."""

    bucket_x: float = 0.07
    bucket_y: float = 0.045
    min_hits: int = 2
    brand: str = "bilibili"
    pad_x: float = 0.018
    pad_y: float = 0.012
    min_w: float = 0.14
    min_h: float = 0.045
    max_w: float = 0.40
    max_h: float = 0.16
    max_texts: int = 8

    def __post_init__(self) -> None:
        _at_least(self, bucket_x=0.02, bucket_y=0.015, min_hits=1, min_w=0.02, min_h=0.02)


def search_limit(limit: int) -> int:
    """Result limit of a search request: 30 when not given, never above 100."""
    return 30 if limit <= 0 else min(limit, 100)


def expansion_limit(limit: int) -> int:
    """Phrase limit of a search request: 4 when not given, never above 8."""
    return 4 if limit <= 0 else min(limit, 8)


def per_query_limit(limit: Column, phrases: Column, channel: bool = False) -> Column:
    """How many rows one (source, phrase) pair may contribute to a request of this limit."""
    if channel:
        return F.least(F.lit(100), F.greatest(F.lit(30), limit * 4))
    return F.greatest(F.lit(10), F.ceil(limit / F.greatest(F.lit(1), phrases)))
