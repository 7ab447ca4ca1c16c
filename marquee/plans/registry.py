"""All queries of the core with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module


class Book:
    """Collects a module's queries and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


MODULES = ["training_queries", "relational_queries", "report_queries", "scalar_queries", "model_queries", "group_queries", "consensus_queries", "source_queries", "stream_queries"]


def collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            module = import_module(f"marquee.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"marquee.plans.{name}":
                raise
            continue
        out |= getattr(module, attribute)
    return out
