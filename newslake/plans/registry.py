"""Registry of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from newslake.plans.views import VIEWS
from newslake.sources.adapters import Tables

QueryFn = Callable[[Tables], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = "") -> Callable[[QueryFn], QueryFn]:
        """Register a query; ``views`` names the canonical tables its SQL reads."""

        def wrap(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = with_views(views.split(), dedent(sql).strip())
            return fn

        return wrap

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(fn: QueryFn) -> Callable[[SparkSession, str], DataFrame]:
            def run(spark: SparkSession, path: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return fn(Tables(spark, path))
            return run

        return {name: bind(fn) for name, fn in self.queries.items()}


def with_views(names: list[str], body: str) -> str:
    """Prefix a SELECT with the common table expressions it needs, dependencies first."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0]:
            need(dep)
        ordered.append(name)

    for n in names:
        need(n)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


REGISTRY = Registry()
