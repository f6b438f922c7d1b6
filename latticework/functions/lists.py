"""List functions and quantifiers with three-valued logic, as higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def head(c) -> Column:
    """Null of an empty list."""
    return F.get(_c(c), 0)


def last(c) -> Column:
    return F.when(F.size(_c(c)) > 0, F.element_at(_c(c), -1))


def at(c, i: int) -> Column:
    """Zero-based; negative from the end; null beyond."""
    return F.get(_c(c), i) if i >= 0 else F.when(F.size(_c(c)) >= -i, F.element_at(_c(c), i))


def cut(c, start: int, end: int) -> Column:
    """``[start, end)``, both not negative."""
    return F.slice(_c(c), start + 1, max(end - start, 0))


def numbers(a, b, step: int = 1) -> Column:
    """From a to b, both included; empty where the step leads away."""
    x, y = _c(a), _c(b)
    ahead = (x <= y) if step > 0 else (x >= y)
    return F.when(ahead, F.sequence(x, y, F.lit(step).cast("long"))).when(x.isNotNull() & y.isNotNull(), F.array().cast("array<bigint>"))


def any_of(c, test: Callable[[Column], Column]) -> Column:
    """Null if none is true and some are unknown."""
    return F.exists(_c(c), test)


def all_of(c, test: Callable[[Column], Column]) -> Column:
    return F.forall(_c(c), test)


def none_of(c, test: Callable[[Column], Column]) -> Column:
    return ~F.exists(_c(c), test)


def single_of(c, test: Callable[[Column], Column]) -> Column:
    """Exactly one; null if unknowns could decide."""
    true, unknown = F.size(F.filter(_c(c), test)), F.size(F.filter(_c(c), lambda x: test(x).isNull()))
    return F.when(true > 1, False).when(unknown == 0, true == 1)
