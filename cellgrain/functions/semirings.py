"""Pairs of operations that a product of tensors may use in place of plus and times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """``combine`` pairs two values, ``aggregate`` gathers the pairs; ``zero`` is what an absent cell stands for.

    ``domain``: a condition that values must meet for the laws to hold, or None.
    """

    name: str
    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    zero: float
    domain: Callable[[Column], Column] | None = None

    def merge(self, a: Column, b: Column) -> Column:
        """``aggregate`` of two values."""
        if self.aggregate is F.sum:
            return a + b
        return F.greatest(a, b) if self.aggregate is F.max else F.least(a, b)


_nonnegative = lambda v: v >= 0

SEMIRINGS = {
    s.name: s
    for s in (
        Semiring("sum-prod", F.sum, lambda a, b: a * b, 0.0),
        Semiring("bool-or-and", F.max, F.least, 0.0, lambda v: v.isin(0.0, 1.0)),
        Semiring("max-prod", F.max, lambda a, b: a * b, 0.0, _nonnegative),
        Semiring("min-prod", F.min, lambda a, b: a * b, float("inf"), lambda v: v > 0),
        Semiring("max-plus", F.max, lambda a, b: a + b, float("-inf")),
        Semiring("min-plus", F.min, lambda a, b: a + b, float("inf")),
    )
}


def semiring(name: str | Semiring) -> Semiring:
    if isinstance(name, Semiring):
        return name
    if name not in SEMIRINGS:
        raise KeyError(f"no semiring {name!r}; there are {', '.join(SEMIRINGS)}")
    return SEMIRINGS[name]
