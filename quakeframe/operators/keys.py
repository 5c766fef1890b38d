"""Joins in which null keys are keys like others, so that no operator loses rows that lack one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", more=None) -> DataFrame:
    """`left` with the other columns of `right`, by `keys`, which may be null. `more(left, right)` is a further condition."""
    names = {k: f"_on_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    on: Column = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[names[k]])
    if more is not None:
        on = on & more(left, r)
    return left.join(r, on, how).drop(*names.values()) if how not in ("left_semi", "left_anti") else left.join(r, on, how)


def number(x: Column) -> Column:
    """NaN as null: it compares as false with everything."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))
