"""Engine parameters (one frozen object, passed to every operator)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference's for identical results: the severities, and EngineConfig's defaults.
VELOCITY_SEVERITIES = (95, 80, 60)
AMOUNT_SEVERITIES = (90, 70, 50)


@dataclass(frozen=True)
class EngineConfig:
    window: str = "1 hour"
    window_label: str = "1h"
    velocity_tiers: dict = field(
        default_factory=lambda: {
            "IP": ((100, 95), (80, 80), (60, 60)),
            "USER": ((60, 95), (45, 80), (30, 60)),
            "DEVICE": ((60, 95), (45, 80), (30, 60)),
            "MERCHANT": ((300, 95), (200, 80), (150, 60)),
        }
    )
    amount_tiers: tuple = ((50000.0, 90), (20000.0, 70), (10000.0, 50))
    block_cut: int = 80
    review_cut: int = 30
    blacklist_severity: int = 100
    ring_min_users: int = 3
    contamination: float = 0.1
    min_training_samples: int = 50
    retrain_interval: int = 100
    seed: int = 42
    n_trees: int = 100
    max_samples: int = 256
    feedback_retrain_threshold: int = 100
    retrain_check_seconds: int = 300
    max_traffic_split: float = 0.5
    min_sample_size: int = 500
    ab_buckets: int = 10000
    watermark: str = "24 hours"
    # alert changelogs: the time of a chunk, and how many rows one may have before it is cut by rank
    changelog_chunk_ms: int = 60_000
    changelog_chunk_rows: int = 1_000_000
    flagged_score: float = 0.3
    risk_threshold: float = 0.8

    def alert_threshold(self, dimension: str) -> int:
        return min(t for t, _ in self.velocity_tiers[dimension])

    @property
    def window_ms(self) -> int:
        n, unit = self.window.split()
        mult = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
        return int(n) * mult[unit.rstrip("s")]

    def with_(self, **kw) -> "EngineConfig":
        return replace(self, **kw)


REFERENCE = EngineConfig()

# Test/fixture profile: the driver tables never reach the 1-hour thresholds, so the
# registered queries use 1-day windows with scaled tiers (severities unchanged).
DAILY = EngineConfig(
    window="1 day",
    window_label="1d",
    velocity_tiers={
        "IP": ((4, 95), (3, 80), (2, 60)),
        "USER": ((8, 95), (6, 80), (4, 60)),
        "DEVICE": ((8, 95), (6, 80), (4, 60)),
        "MERCHANT": ((80, 95), (70, 80), (60, 60)),
    },
    amount_tiers=((4000.0, 90), (400.0, 70), (250.0, 50)),
)
