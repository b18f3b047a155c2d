"""Named queries: a Spark callable and, where SQL can say it, the checking statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    def add(self, name: str, sql: str | None = None):
        """Decorator that registers a query under ``name``."""

        def wrap(fn):
            if name in self:
                raise ValueError(f"duplicate query {name}")
            self[name] = Query(fn, sql)
            return fn

        return wrap
