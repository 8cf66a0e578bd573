"""One registered query per operator, each with its equivalent SQL."""

from __future__ import annotations

from . import base, basics, kpi_queries, ml_queries, quality_queries, study_queries, time_queries

MODULES = (basics, quality_queries, kpi_queries, time_queries, study_queries, ml_queries)


def queries():
    out = {}
    for m in MODULES:
        out.update(m.BOOK.queries)
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out.update(m.BOOK.oracles)
    return out


def operator_ids():
    """Query name -> survey ids it answers for."""
    out = {}
    for m in MODULES:
        out.update(m.BOOK.ids)
    return out


__all__ = ["base", "operator_ids", "oracle_sql", "queries"]
