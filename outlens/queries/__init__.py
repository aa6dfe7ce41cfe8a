"""Registered queries of the engine, with SQL for a second engine where SQL can say the same."""

from __future__ import annotations


def all_queries() -> dict:
    from . import engine, explain, scoring, sql  # noqa: F401  they register themselves

    return dict(explain.QUERIES)


def all_oracles() -> dict[str, str]:
    from . import engine, explain, scoring, sql  # noqa: F401

    return dict(explain.ORACLES)
