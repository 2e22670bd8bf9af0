"""Thresholds of the reports, all adjustable per call."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

from dealflow import labels as L


# Days without activity that each stage allows.
STAGE_LIMITS = {
    L.PROSPECTING: 5,
    L.QUALIFICATION: 5,
    L.DISCOVERY: 7,
    L.PROPOSAL: 7,
    L.NEGOTIATION: 5,
    L.CONTRACT: 3,
    L.CLOSING: 3,
}


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs, weights and limits; the defaults give the standard reports."""

    # Stage age and closing windows, in days
    stuck_days: int = 7
    near_days: int = 30
    mid_days: int = 90

    # Pipeline-to-quota ratios below which a rep is critical, at risk, below target
    coverage_cuts: tuple[float, float, float] = (1, 2, 3)

    # Upper ends (exclusive) of the Small, Mid and Large size tiers
    size_cuts: tuple[int, int, int] = (10_000, 50_000, 100_000)

    # Upper ends (inclusive) of the sales cycle buckets, in days
    cycle_cuts: tuple[int, ...] = (15, 30, 60, 90)

    # Idle time: more than the first is idle, more than the second is long idle
    idle_days: int = 7
    long_idle_days: int = 14

    # Health score: points lost per risk
    penalty_stalled: int = 25
    penalty_overdue: int = 20
    penalty_long_cycle: int = 20
    penalty_stuck: int = 15
    penalty_long_idle: int = 10
    penalty_idle: int = 5
    penalty_low_probability: int = 10
    low_probability: int = 30
    stuck_factor: int = 2
    no_benchmark_days: int = 999
    intervene_points: int = 40
    attention_points: int = 15
    health_critical: int = 40
    health_good: int = 70

    # Priority queue: points gained per signal
    priority_overdue: int = 50
    priority_due_soon: int = 40
    priority_stalled: int = 30
    priority_idle: int = 20
    priority_commit: int = 15
    priority_enterprise: int = 10
    priority_size_unit: int = 10_000
    priority_size_cap: int = 10
    due_soon_days: int = 7

    # Forecast suggestion: historical win rates in percent
    omit_days_in_stage: int = 14
    rate_commit: float = 70
    rate_best_case: float = 50
    rate_upside: float = 30
    rate_low: float = 40

    # Pipeline gaps as shares of the quota
    gap_mid_share: float = 0.5
    gap_near_share: float = 0.3

    # Stale deals: limit per stage and its multiples
    stage_limits: Mapping[str, int] = field(default_factory=lambda: MappingProxyType(STAGE_LIMITS))
    stale_urgent: int = 2
    stale_dead: int = 3

    # Loss patterns
    pattern_min_deals: int = 3
    pattern_loss_rate: float = 50

    # Routing
    senior_months: int = 12
    capacity_deals: int = 10
    # Best candidates given per prospect; None for all
    match_candidates: int | None = None

    # Lead source grades, in percent
    grade_a_win: float = 60
    grade_a_stall: float = 30
    grade_b_win: float = 40
    grade_d_stall: float = 50

    # Rows of the campaign ranking and of the loss reasons
    top_n: int = 10
    top_reasons: int = 10

    # Commit accuracy profiles, in percent
    accuracy_cuts: tuple[float, float, float] = (80, 60, 40)

    # Scale: a lookup up to this size is broadcast, a larger one is joined by salted shuffle
    broadcast_rows: int = 200_000
    broadcast_chars: int = 32_000_000
    # Scale: a group up to this many rows is sorted by one task, a larger one is split
    task_rows: int = 2_000_000
    # Scale: a list is joined in slices of so many bytes; a text can have so many in a JVM
    list_slice_bytes: int = 64_000_000
    cell_bytes: int = 2_000_000_000


DEFAULTS = Thresholds()
