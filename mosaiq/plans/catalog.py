"""Loads every query family and exposes the registry."""

from mosaiq.plans import q_evidence, q_jobs, q_pixels, q_regions, q_routing, q_selection, q_streaming  # noqa: F401
from mosaiq.plans.registry import all_oracles as oracles, all_queries as queries  # noqa: F401
