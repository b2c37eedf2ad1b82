"""Registered queries: name -> function of (spark, sf_dir), and the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from .standins import table, with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t.hits is the stand-in or table of that name."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return table(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", sql: str | None = None) -> Callable:
    """Registers a function of Tables; sql is over the named stand-ins and the driver's tables."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql)
        return function

    return add
