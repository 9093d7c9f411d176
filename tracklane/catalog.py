"""Queries over the driver's tables, one or more for each operator, with the SQL they are held against."""

from __future__ import annotations

from tracklane.plans import contrast_plans, encoder_plans, event_plans, map_plans, model_plans, rate_plans, remap_plans, score_plans, session_plans  # noqa: F401  they register their queries
from tracklane.plans.registry import ORACLE, QUERIES


def flagship(spark, where):
    return QUERIES["d1_session_performance"](spark, where)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
