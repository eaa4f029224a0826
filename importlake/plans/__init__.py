"""Registered queries, each with the SQL that checks it where SQL can."""

from importlib import import_module

MODULES = ["q_history", "q_stats", "q_text", "q_retail", "q_costing", "q_enrich", "q_ingest", "q_search", "q_matching", "q_stream"]


def load() -> None:
    """Import the modules that register queries."""
    for m in MODULES:
        import_module(f"importlake.plans.{m}")
