"""Equi-joins on columns of any name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from diffloom.functions.names import col


def on_columns(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """left joined with right where the columns are equal (null meets nothing); they come once, from the left."""
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, reduce(lambda a, b: a & b, (col(c, "l") == col(c, "r") for c in columns)), how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*(col(c, "l") for c in left.columns), *(col(c, "r") for c in right.columns if c not in set(columns)))
