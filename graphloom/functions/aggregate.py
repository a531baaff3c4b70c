"""Aggregates by lower-case name: (function of the argument column and whether it is distinct, kind of the result)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Aggregate = tuple[Callable[[Column, bool], Column], str]

AGGREGATES: dict[str, Aggregate] = {
    "count": (lambda x, distinct: F.count_distinct(x) if distinct else F.count(x), "int"),
    "sum": (lambda x, distinct: F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0)), "same"),
    "min": (lambda x, distinct: F.min(x), "same"),
    "max": (lambda x, distinct: F.max(x), "same"),
    "avg": (lambda x, distinct: F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x), "float"),
    "collect": (lambda x, distinct: F.collect_set(x) if distinct else F.collect_list(x), "list"),
    "stdev": (lambda x, distinct: F.coalesce(F.stddev_samp(x), F.lit(0.0)), "float"),
    "stdevp": (lambda x, distinct: F.coalesce(F.stddev_pop(x), F.lit(0.0)), "float"),
}
#: With a second argument, a constant.
PERCENTILES: dict[str, Callable[[Column, float], Column]] = {
    "percentilecont": lambda x, p: F.percentile(x, p),
    "percentiledisc": lambda x, p: F.percentile_approx(x, p, 1_000_000),
}


def register(name: str, function: Callable[[Column, bool], Column], kind: str = "any") -> None:
    """Make an aggregate known to queries."""
    AGGREGATES[name.lower()] = (function, kind)
