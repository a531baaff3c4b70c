"""Scalar functions by lower-case name: (least and most arguments, function of columns, kind of the result).

A kind is int, float, str, bool, list, map, any, or "same" for the first argument's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Scalar = tuple[int, int, Callable[..., Column], str]


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    return F.substr(s, start + 1, n) if n is not None else F.substr(s, start + 1)


def _range(a: Column, b: Column, step: Column | None = None) -> Column:
    step = F.lit(1).cast("long") if step is None else step
    empty = F.array().cast("array<bigint>")
    return F.when((step > 0) & (a > b) | (step < 0) & (a < b), empty).otherwise(F.sequence(a, b, step))


SCALARS: dict[str, Scalar] = {
    "abs": (1, 1, F.abs, "same"),
    "ceil": (1, 1, lambda x: F.ceil(x).cast("double"), "float"),
    "floor": (1, 1, lambda x: F.floor(x).cast("double"), "float"),
    "round": (1, 2, lambda x, n=None: F.round(x.cast("double")) if n is None else F.round(x.cast("double"), n), "float"),
    "sign": (1, 1, lambda x: F.signum(x).cast("long"), "int"),
    "sqrt": (1, 1, F.sqrt, "float"),
    "exp": (1, 1, F.exp, "float"),
    "log": (1, 1, F.ln, "float"),
    "log10": (1, 1, F.log10, "float"),
    "sin": (1, 1, F.sin, "float"),
    "cos": (1, 1, F.cos, "float"),
    "tan": (1, 1, F.tan, "float"),
    "atan2": (2, 2, F.atan2, "float"),
    "pi": (0, 0, lambda: F.pi(), "float"),
    "e": (0, 0, lambda: F.e(), "float"),
    "tolower": (1, 1, F.lower, "str"),
    "lower": (1, 1, F.lower, "str"),
    "toupper": (1, 1, F.upper, "str"),
    "upper": (1, 1, F.upper, "str"),
    "trim": (1, 1, F.trim, "str"),
    "ltrim": (1, 1, F.ltrim, "str"),
    "rtrim": (1, 1, F.rtrim, "str"),
    "replace": (3, 3, F.replace, "str"),
    "substring": (2, 3, _substring, "str"),
    "left": (2, 2, F.left, "str"),
    "right": (2, 2, F.right, "str"),
    "reverse": (1, 1, F.reverse, "same"),
    "split": (2, 2, lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1), "list"),
    "tointeger": (1, 1, lambda x: x.try_cast("double").try_cast("long"), "int"),
    "tofloat": (1, 1, lambda x: x.try_cast("double"), "float"),
    "tostring": (1, 1, lambda x: x.cast("string"), "str"),
    "toboolean": (1, 1, lambda x: x.try_cast("boolean"), "bool"),
    "coalesce": (1, 99, F.coalesce, "same"),
    "head": (1, 1, lambda x: F.get(x, F.lit(0)), "any"),
    "last": (1, 1, lambda x: F.try_element_at(x, F.lit(-1)), "any"),
    "tail": (1, 1, lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), "list"),
    "range": (2, 3, _range, "list"),
    "char_length": (1, 1, lambda x: F.length(x).cast("long"), "int"),
}



def register(name: str, function: Callable[..., Column], kind: str = "any", least: int = 1, most: int = 1) -> None:
    """Make a function of columns known to queries."""
    SCALARS[name.lower()] = (least, most, function, kind)
