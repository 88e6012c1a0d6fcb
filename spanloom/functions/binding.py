"""Computing an expression once where it is used several times.

The optimizer copies expressions into filters that it moves down and into
lambda bodies, where they would be evaluated again for every use or element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once per row, whatever is done with them later."""
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)
