"""Registered queries with their SQL."""

from __future__ import annotations


def _modules():
    from tessella.plans import clustering, core, density, enrichment, genomics, graphs, hypotheses, more, ranks, regression, statistics, tracks, trees

    return [core, statistics, more, hypotheses, regression, ranks, genomics, graphs, tracks, trees, clustering, density, enrichment]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
