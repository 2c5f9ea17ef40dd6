"""The queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import queries as plans
    from .plans import serves  # noqa: F401  (adds its queries)

    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    from .plans import queries as plans
    from .plans import serves  # noqa: F401  (adds its queries)

    return dict(plans.SQL)
