"""All registered queries and their SQL texts."""

from __future__ import annotations

from cohortry.plans import (
    drift_queries, job_queries, metric_queries, model_queries, quality_queries, split_queries,
    text_queries,
)

_MODULES = (quality_queries, split_queries, drift_queries, metric_queries, text_queries,
            model_queries, job_queries)


def all_queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
