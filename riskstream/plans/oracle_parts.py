"""SQL fragments shared by the DuckDB oracles (daily profile)."""

from __future__ import annotations

from riskstream.config import DAILY, EngineConfig
from riskstream.operators.velocity import DIMENSIONS


def dims_sql(src: str = "fx_transactions") -> str:
    parts = [
        f"SELECT '{d}' AS dimension, {c} AS dimension_key, amount, event_time, transaction_id FROM {src}"
        for d, c in DIMENSIONS
    ]
    return "\nUNION ALL\n".join(parts)


def threshold_case(cfg: EngineConfig = DAILY, col: str = "dimension") -> str:
    whens = " ".join(f"WHEN '{d}' THEN {cfg.alert_threshold(d)}" for d, _ in DIMENSIONS)
    return f"CASE {col} {whens} END"


def velocity_case(cfg: EngineConfig = DAILY, what: str = "severity") -> str:
    whens = []
    for d, tiers in cfg.velocity_tiers.items():
        for t, s in tiers:
            whens.append(f"WHEN upper(coalesce(dimension, '')) = '{d}' AND coalesce(txn_count, 0) >= {t} "
                         f"THEN {s if what == 'severity' else t}")
    return "CASE " + " ".join(whens) + " END"


def amount_case(cfg: EngineConfig = DAILY, what: str = "severity") -> str:
    whens = [f"WHEN coalesce(total_amount, 0) >= {t} THEN {s if what == 'severity' else t}"
             for t, s in cfg.amount_tiers]
    return "CASE " + " ".join(whens) + " END"


def windows_sql(cfg: EngineConfig = DAILY) -> str:
    w = cfg.window_ms
    return f"""
SELECT dimension, '{cfg.window_label}' AS window_size, dimension_key, COUNT(*) AS txn_count,
       CAST(SUM(CAST(amount AS DECIMAL(12,2))) AS DOUBLE) AS total_amount,
       ((epoch_us(event_time) // 1000) // {w}) * {w} AS window_start,
       ((epoch_us(event_time) // 1000) // {w}) * {w} + {w} AS window_end
FROM dims WHERE dimension_key IS NOT NULL AND dimension_key <> ''
GROUP BY dimension, dimension_key, ((epoch_us(event_time) // 1000) // {w})"""


def alerts_sql(cfg: EngineConfig = DAILY) -> str:
    return f"SELECT * FROM windows WHERE txn_count >= {threshold_case(cfg)}"


def union_sql(sevs: list[str]) -> str:
    """1 - prod(1 - s/100) folded left in the given order, rounded half-even, capped at 100."""
    prod = "1.0::DOUBLE"
    for s in sevs:
        prod = f"({prod} * (1.0::DOUBLE - coalesce(CAST({s} AS DOUBLE), 0.0::DOUBLE) / 100.0::DOUBLE))"
    return f"CAST(least(round_even((1.0::DOUBLE - {prod}) * 100.0::DOUBLE, 0), 100) AS BIGINT)"


def route_sql(score: str, cfg: EngineConfig = DAILY) -> str:
    return f"CASE WHEN {score} >= {cfg.block_cut} THEN 'block' WHEN {score} >= {cfg.review_cut} THEN 'review' ELSE 'allow' END"
