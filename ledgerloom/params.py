"""Every threshold the analyses use, in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # churn rules
    at_risk_days: int = 30
    confirmed_days: int = 65
    adaptive_floor_days: int = 21
    adaptive_multiplier: float = 2.0
    default_p90_gap: float = 15.0
    default_mean_gap: float = 5.0
    min_baseline_gaps: int = 5
    prior_window_days: int = 90
    decay_ratio: float = 0.25

    # calendar windows, in months
    baseline_months: int = 6
    label_months: int = 6
    # Pick the degraded issuer from the months before the label window only, as a model to be deployed must.
    issuer_as_of_label: bool = False
    trailing_months: int = 3
    run_rate_months: int = 3
    retention_index: int = 3

    # scoring buckets
    rfm_buckets: int = 5
    exposure_buckets: int = 10
    min_baseline_attempts: int = 50

    # money
    take_rate_bps: float = 42.0

    # rule evaluation
    fixed_windows: tuple[int, int, int] = (10, 120, 5)
    multiplier_grid: tuple[float, float, float] = (1.0, 6.0, 0.25)
    confirm_precision: float = 0.95
    outcome_days: int = 90

    # driver model
    test_share: float = 0.30
    split_seed: int = 7
    inverse_penalty: float = 1.0
    cutoffs: int = 4
    cutoff_step_days: int = 180
    boost_rounds: int = 300
    boost_step: float = 0.06
    boost_depth: int = 4

    # segmentation
    k_range: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    k_restarts: int = 10
    final_restarts: int = 25
    cluster_seed: int = 7

    # forecasting
    holdout_months: int = 5
    rolling_origins: int = 6
    horizon_months: int = 6
    season_months: int = 12
    low_sr: float = 0.92
    holt_grid: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)
    damping_grid: tuple[float, ...] = (0.8, 0.9, 0.98)
    arma_grid: tuple[float, ...] = (-0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8)

    # trailing success-rate smoothing: weight of the newest month
    ewma_weight: float = 0.55

    # physical layout
    hot_group_rows: int = 1_000_000
    buckets: int | None = None

    # The expected sign of each driver, for the recovery check
    expected_signs: dict[str, int] = field(default_factory=lambda: {
        "success_rate_3m_at_cutoff": -1,
        "avg_settlement_delay_days": 1,
        "tickets_unresolved": 1,
        "tenure_months": -1,
        "competitor_density": 1,
        "avg_monthly_txns": -1,
    })

    @property
    def take_rate(self) -> float:
        return self.take_rate_bps / 10000.0
