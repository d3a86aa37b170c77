"""CASE WHEN from a list of branches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def case(branches: list[tuple[Column, Column]], default: Column) -> Column:
    if not branches:
        return default
    (condition, value), *rest = branches
    expression = F.when(condition, value)
    for condition, value in rest:
        expression = expression.when(condition, value)
    return expression.otherwise(default)
