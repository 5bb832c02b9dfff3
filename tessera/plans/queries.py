"""All queries of the library's own operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ("operators.content", "operators.metrics", "operators.fields", "operators.windows", "operators.sessions", "operators.selection", "operators.retrieval", "operators.memory", "operators.evals", "operators.compressors", "operators.adaptive", "operators.telemetry", "operators.structure", "operators.routing", "streaming.events")


def catalogue() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        for key, pair in import_module(f"tessera.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"two queries are called {key}")
            out[key] = pair
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in catalogue().items() if sql}
