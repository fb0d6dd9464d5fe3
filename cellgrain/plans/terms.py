"""Aggregate arguments as sums of terms: coefficient x measures x conditions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..errors import BindError
from . import nodes as n


@dataclass(frozen=True)
class Measure:
    """``owner`` is a cube, or a dimension with a measure of its own."""

    owner: str
    name: str
    of_dimension: bool = False

    def __str__(self) -> str:
        return f"{self.owner}.{self.name}" if self.of_dimension or self.owner != self.name else self.name


@dataclass(frozen=True)
class Mask:
    """A CASE branch: ``condition`` holds and none of ``before`` does; without a condition, just the latter (ELSE)."""

    condition: object
    before: tuple = ()

    def __str__(self) -> str:
        return " AND ".join([f"[{self.condition}]"] * (self.condition is not None) + [f"[NOT {b}]" for b in self.before])


@dataclass(frozen=True)
class Term:
    coef: float
    measures: tuple[Measure, ...] = ()
    masks: tuple[Mask, ...] = ()

    def times(self, other: Term) -> Term:
        return Term(self.coef * other.coef, self.measures + other.measures, self.masks + other.masks)

    def scaled(self, by: float) -> Term:
        return Term(self.coef * by, self.measures, self.masks)

    @property
    def cubes(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m.owner for m in self.measures if not m.of_dimension))

    @property
    def dimensions(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m.owner for m in self.measures if m.of_dimension))

    def power(self, cube: str) -> int:
        return sum(1 for m in self.measures if not m.of_dimension and m.owner == cube)

    def __str__(self) -> str:
        parts = ([] if self.coef == 1 and (self.measures or self.masks) else [f"{self.coef:g}"]) + [str(m) for m in self.measures] + [str(m) for m in self.masks]
        return " * ".join(parts)


def normalize(expr, resolve: Callable[[n.Name], Measure]) -> list[Term]:
    """Distribute products over sums, fold constants, turn CASE branches into masks."""
    if isinstance(expr, n.Star):
        return [Term(1.0)]
    if isinstance(expr, n.Literal):
        if isinstance(expr.value, str):
            raise BindError(f"{expr} is no number")
        return [Term(float(expr.value))]
    if isinstance(expr, n.Name):
        return [Term(1.0, (resolve(expr),))]
    if isinstance(expr, n.Aggregate):
        raise BindError(f"aggregate {expr} within an aggregate")
    if isinstance(expr, n.Case):
        out, before = [], ()
        for condition, value in expr.branches:
            mask = Mask(condition, before)
            out += [Term(t.coef, t.measures, (mask, *t.masks)) for t in normalize(value, resolve)]
            before += (condition,)
        if expr.otherwise is not None:
            mask = Mask(None, before)
            out += [Term(t.coef, t.measures, (mask, *t.masks)) for t in normalize(expr.otherwise, resolve)]
        return [t for t in out if t.coef]
    if isinstance(expr, n.Arithmetic):
        left, right = normalize(expr.left, resolve), normalize(expr.right, resolve)
        if expr.op in "+-":
            return left + [t.scaled(1.0 if expr.op == "+" else -1.0) for t in right]
        if expr.op == "*":
            return [a.times(b) for a in left for b in right]
        if any(t.measures or t.masks for t in right):
            raise BindError(f"division by {expr.right}: only constants divide within an aggregate")
        if not (by := sum(t.coef for t in right)):
            raise BindError("division by zero")
        return [t.scaled(1 / by) for t in left]
    raise BindError(f"{expr} can't be aggregated")


def conditions_of(expr) -> list:
    """The conditions of all CASE branches in an expression."""
    if isinstance(expr, n.Case):
        out = [c for c, _ in expr.branches]
        return out + [c for _, v in expr.branches for c in conditions_of(v)] + (conditions_of(expr.otherwise) if expr.otherwise is not None else [])
    if isinstance(expr, n.Arithmetic):
        return conditions_of(expr.left) + conditions_of(expr.right)
    return []


def conjuncts(condition) -> list:
    if condition is None:
        return []
    return conjuncts(condition.left) + conjuncts(condition.right) if isinstance(condition, n.Both) else [condition]


def names_of(condition) -> list[n.Name]:
    """Columns that a condition looks at; those of a subquery come as they stand there."""
    if isinstance(condition, (n.Both, n.Either)):
        return names_of(condition.left) + names_of(condition.right)
    if isinstance(condition, n.Negation):
        return names_of(condition.inner)
    if isinstance(condition, n.AmongQuery):
        return [condition.left] + (names_of(condition.query.where) if condition.query.where is not None else [])
    if isinstance(condition, n.Compare):
        return [x for x in (condition.left, condition.right) if isinstance(x, n.Name)]
    return [condition.left]
