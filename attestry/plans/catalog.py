"""Registry of queries: one entry per operator, with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attestry.plans.adapters import VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    title: str
    run: Callable[[Tables], DataFrame]
    reads: str
    check: str | None

    @property
    def sql(self) -> str | None:
        """The whole SQL check, the views it reads written out in front."""
        return None if self.check is None else with_views(self.reads, self.check)


REGISTRY: dict[str, Query] = {}
# SQL-only views the checks build on: name -> (views read, SELECT).
CHECK_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, title: str, reads: str = "", sql: str | None = None):
    """Register a query; `reads` names the views its SQL check selects from."""
    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Query(name, title, fn, reads, sql)
        return fn

    return keep


def check_view(name: str, reads: str, sql: str) -> None:
    CHECK_VIEWS[name] = (tuple(reads.split()), sql)


def with_views(reads: str, sql: str) -> str:
    order: list[str] = []

    def deps(name: str) -> tuple[str, ...]:
        return CHECK_VIEWS[name][0] if name in CHECK_VIEWS else VIEWS[name][0]

    def visit(name: str) -> None:
        if name not in VIEWS and name not in CHECK_VIEWS:
            return  # a test table
        for dep in deps(name):
            visit(dep)
        if name not in order:
            order.append(name)

    for n in reads.split():
        visit(n)
    if not order:
        return sql
    # Each view is written out once, however many others read it.
    parts = []
    for n in order:
        body = CHECK_VIEWS[n][1] if n in CHECK_VIEWS else VIEWS[n][1].format(
            **{d: d for d in VIEWS[n][0]})
        parts.append(f"{n} AS MATERIALIZED ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + sql


def load() -> dict[str, Query]:
    from attestry.plans import (  # noqa: F401
        queries_columns,
        queries_evidence,
        queries_graph,
        queries_measure,
        queries_review,
        queries_sites,
        queries_sources,
        queries_streams,
    )

    return REGISTRY


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.run(Tables(spark, sf_dir))

    call.__name__ = q.name
    call.__doc__ = q.title
    return call
