"""Queries on the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its checking SQL."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_catalog(sql)
        return fn
    return keep


def with_catalog(body: str) -> str:
    """Put the catalog views in front of ``body`` (a select, or more CTEs)."""
    from temblor.sources.catalog import CATALOG_SQL

    glue = "" if body.lstrip().lower().startswith("select") else ","
    return f"with recursive {CATALOG_SQL}{glue}\n{body.strip()}"


def load_all() -> None:
    from temblor.registered import (  # noqa: F401
        clustering, cleaning, features, forecast, metrics, patterns, ranges, spatial, streams,
        summaries, temporal,
    )
    from temblor.registered import branches  # noqa: F401  (after those whose SQL it shares)
