"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

GROUPS = ["pages", "gates", "outcomes", "streaming"]


def all_queries() -> dict:
    out: dict = {}
    for g in GROUPS:
        out.update(importlib.import_module(f"webtide.plans.queries_{g}").QUERIES)
    return out


def all_oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for g in GROUPS:
        for k, f in importlib.import_module(f"webtide.oracle.sql_{g}").SQL.items():
            out[k] = f()
    return out
