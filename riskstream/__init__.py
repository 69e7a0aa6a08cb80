"""riskstream: velocity and risk analytics on transaction tables and streams, on Spark.

Subpackages
-----------
sources    table loading, fixture views derived from the driver tables, JSON decode, upserts
functions  Column-level helpers (rounding, probabilistic union, tiers, hashing, formatting)
operators  DataFrame operators: velocity, rules, scoring, graph, isolation forest, A/B, feedback,
           dashboard, prompt rendering, data quality
plans      the registered queries and their SQL oracles
streaming  Structured Streaming twins of the velocity / scoring path
"""

from riskstream.config import DAILY, REFERENCE, EngineConfig

__all__ = ["EngineConfig", "REFERENCE", "DAILY"]
