"""Binding of intermediate results, so that an expression that uses one often holds it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; expression trees stay as small as they are written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
