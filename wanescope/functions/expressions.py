"""Small helpers to write long expressions with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once: an optimiser that moves the expression can't move value into f's lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
