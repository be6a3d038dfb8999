"""The query catalogue: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from hewn.plans import analysis, choosing, closing, extended, kernels, landing, linking, measuring, relational, scan, scoring, stateful, surface
from hewn.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "analysis", "choosing", "closing", "extended", "kernels", "landing", "linking", "measuring", "relational", "scan", "scoring", "stateful", "surface"]


def FLAGSHIP(spark, d):
    return QUERIES["e1_greedy_skip"](spark, d)
