"""All registered queries by name, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from topicgauge.plans.checked import CHECKED
from topicgauge.plans.sql import SQL
from topicgauge.plans.stateful import STATEFUL
from topicgauge.session import apply_settings, ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    """The query, in a session that has the package and tells times in UTC."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        apply_settings(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Query] = {query.__name__: _prepared(query) for query in [*CHECKED, *STATEFUL]}

__all__ = ["QUERIES", "SQL"]
