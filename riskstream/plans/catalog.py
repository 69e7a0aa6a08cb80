"""Import every query module so the registry is filled."""

from __future__ import annotations

from riskstream.plans import q_ab, q_dashboard, q_feedback, q_graph, q_io, q_model, q_render, q_stream, q_velocity  # noqa: F401
from riskstream.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
