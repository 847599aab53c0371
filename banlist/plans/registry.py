"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from banlist.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: Sequence[str] = (), sql: str | None = None):
    """Register a query; ``sql`` reads the named oracle views."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return run

    return register


def load_all() -> None:
    from banlist.plans import (  # noqa: F401
        metric_queries,
        prompt_queries,
        selection_queries,
        table_queries,
        text_queries,
    )
