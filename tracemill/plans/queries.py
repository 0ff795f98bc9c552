"""The location-history queries over the driver's tables, and the statements that check them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import operator_queries, reports
from .checks import CHECKS
from .dialect import CHECK
from .fixtures import VIEWS, check_views, frame


def _report(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.REPORTS[name](*[frame(spark, sf_dir, k) for k in reports.INPUTS[name]])

    run.__name__ = name
    return run


def with_views(statement: str) -> str:
    """A statement of the checking database with the views that it names in front."""
    views = check_views(CHECK, {v for v in VIEWS if re.search(rf"\b{v}\b", statement)})
    if not views:
        return statement
    for head in ("WITH RECURSIVE ", "WITH "):
        if statement.startswith(head):
            return f"{head}{views}, {statement[len(head):]}"
    return f"WITH {views} {statement}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _report(name) for name in reports.REPORTS} | operator_queries.QUERIES
ORACLE: dict[str, str] = {name: with_views(text) for name, text in (CHECKS | operator_queries.CHECKS).items()}
