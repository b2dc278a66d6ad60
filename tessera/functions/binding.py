"""Binding of a computed value within an expression, so that it is evaluated once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
