"""Registered queries: operator compositions over the given tables, with their SQL twins."""

from folioscan.plans.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
