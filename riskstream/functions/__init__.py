from riskstream.functions.columns import (
    EPOCH_NTZ,
    ab_bucket,
    epoch_ms,
    fmt_amount,
    money,
    prob_union,
    py_round,
    tier_case,
    to_ntz,
)

__all__ = [
    "EPOCH_NTZ",
    "ab_bucket",
    "epoch_ms",
    "fmt_amount",
    "money",
    "prob_union",
    "py_round",
    "tier_case",
    "to_ntz",
]
