"""Registry of the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclelake.plans.views import VIEW_SQL, Views

Build = Callable[[Views], DataFrame]
# Added before rounding to six digits on both sides: engines round exact ties differently.
TIE_SHIFT = 1e-9

_BUILDERS: dict[str, Build] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query over the canonical views; `sql` is its tail after the view definitions.

    A tail starting with `,` adds further common table expressions before its SELECT.
    """

    def register(build: Build) -> Build:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            tail = sql.strip().replace(", 6)", f" + {TIE_SHIFT}, 6)")
            _SQL[name] = f"WITH {VIEW_SQL}{' ' if tail.startswith(',') else chr(10)}{tail}"
        return build

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and doubles at six digits, so two engines can be compared."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "double":
            column = F.round(column + TIE_SHIFT, 6)
        columns.append(column.alias(name))
    return df.select(*columns)


def _load() -> None:
    from cyclelake.plans import (  # noqa: F401
        cause_queries,
        feature_queries,
        file_queries,
        join_queries,
        monitor_queries,
        rollup_queries,
        row_queries,
        stream_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build: Build) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: comparable(build(Views(spark, folder)))

    return {name: bind(build) for name, build in _BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
