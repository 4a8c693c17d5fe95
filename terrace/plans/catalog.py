"""All registered queries, keyed by operator family."""

from __future__ import annotations

from terrace.plans import cleaning_queries, evaluation_queries, model_queries, report_queries  # noqa: F401
from terrace.plans.registry import REGISTRY


def all_queries():
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def all_oracles():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
