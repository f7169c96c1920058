"""Shared argument handling of the function library."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    """A column, or the column of that name."""
    return x if isinstance(x, Column) else F.col(x)


def val(x: Any) -> Column:
    """A column, or a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def fail_if(condition: Column, message: str, otherwise: Column) -> Column:
    """Raise for rows where PostgreSQL raises and Spark would go on."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(otherwise)
