"""Query registry: ``name -> (spark builder, DuckDB oracle text or None)``.

Names are ``<operator id>_<short name>`` after SURVEY §2.  Each builder takes
``(spark, sf_dir)`` and returns a lazy DataFrame over the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (they register on import)."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


MODULES = ["q_reports", "q_functions", "q_metrics", "q_validate", "q_entity", "q_joins", "q_geo", "q_text", "q_streaming", "q_monitor", "q_sources", "q_standardize", "q_windows", "q_jobs"]
