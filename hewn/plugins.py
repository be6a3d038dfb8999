"""Registries of what callers may exchange: token counters, selectors, variants, providers, oracles, formatters, filters and flags.

A plug-in is a function over Columns or DataFrames, so that whatever is plugged in stays in the plan.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hewn.functions import text
from hewn.operators import budget
from hewn.sources import sinks

#: name -> (text column -> token count column)
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "chars4": lambda c: text.approx_tokens(c),
    "chars38": lambda c: text.approx_tokens(c, 3.8),
    "words13": lambda c: F.floor(F.size(F.split(F.trim(F.coalesce(c, F.lit(""))), r"[ \t\r\n]+")) * 1.3).cast("long"),
    "lines10": lambda c: (F.size(F.split(F.coalesce(c, F.lit("")), "\n")) * 10).cast("long"),
}

#: name -> order of (repo_name, row_id, tokens, score, ingested_at)
SELECTORS: dict[str, Callable[[], list[Column]]] = {
    "score": lambda: [F.desc("score"), F.col("row_id")],
    "smallest": lambda: [F.col("tokens"), F.col("row_id")],
    "recent": lambda: [F.desc("ingested_at"), F.col("row_id")],
    "hash": lambda: [F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":42"))), F.col("row_id")],
}

#: name -> (path, content -> text of a section)
FORMATTERS: dict[str, Callable[[Column, Column], Column]] = {f: (lambda p, c, f=f: sinks.section(p, c, f)) for f in ("json", "markdown", "plain", "html", "xml")}

#: variant -> name of the query that executes it; unknown variants are an error
VARIANTS = {"v1": "j3_facility_two_mode", "v2": "j4_coverage", "v3": "j5_stable_demotion", "v4": "j3_facility_two_mode", "v5": "j3_facility_two_mode"}

#: name -> name of the query whose rows are violations, or whose ``violations`` column counts them
ORACLES = {"budget": "o1_budget_oracle", "packs": "o1_pack_oracles", "selection": "o2_selection_oracle"}

#: name -> (spark, dir -> vectors (id, ...)) by the name of the query that provides them
PROVIDERS = {"hashed": "k1_hashed_vectors", "table": "c18_cluster_membership"}


def select(items: DataFrame, selector: str, limit: int, keep: Callable[[], Column] | None = None, key: Callable[[], list[Column]] | None = None) -> DataFrame:
    """Rows of (repo_name, row_id, tokens, score, ingested_at) within ``limit`` tokens per repository, in the selector's order or that of ``key``, of those that the caller's filter ``keep`` lets through."""
    pool = items.filter(keep()) if keep else items
    return budget.break_in_order(pool, "repo_name", key() if key else SELECTORS[selector](), "tokens", limit)


@dataclass(frozen=True)
class Flags:
    """Switches of the engine; each may be set by an environment variable HEWN_<NAME> (1, true, on or yes)."""

    centrality: bool = True
    demotion: bool = True
    patch: bool = True
    quotas: bool = True
    router: bool = False

    @classmethod
    def from_env(cls, env: dict | None = None) -> Flags:
        env = os.environ if env is None else env
        read = lambda f: str(env[k]).lower() in ("1", "true", "on", "yes") if (k := f"HEWN_{f.name.upper()}") in env else f.default
        return cls(**{f.name: read(f) for f in fields(cls)})
