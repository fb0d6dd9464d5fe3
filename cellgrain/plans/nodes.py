"""What a parsed query is made of. Every expression prints as it would be written."""

from __future__ import annotations

from dataclasses import dataclass, field


def _number(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


@dataclass(frozen=True)
class Name:
    """A column, maybe qualified."""

    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal:
    value: object

    def __str__(self) -> str:
        return _number(self.value) if isinstance(self.value, (int, float)) else "'" + str(self.value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Star:
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Case:
    branches: tuple
    otherwise: object = None

    def __str__(self) -> str:
        whens = " ".join(f"WHEN {c} THEN {e}" for c, e in self.branches)
        return f"CASE {whens}" + (f" ELSE {self.otherwise}" if self.otherwise is not None else "") + " END"


@dataclass(frozen=True)
class Over:
    """A window: running over ``order``, for each of ``partition``; ``back`` rows before the current one (None: all)."""

    partition: tuple = ()
    order: Name | None = None
    descending: bool = False
    back: int | None = None
    explicit: bool = False

    def __str__(self) -> str:
        parts = ["PARTITION BY " + ", ".join(map(str, self.partition))] if self.partition else []
        if self.order:
            parts.append(f"ORDER BY {self.order}" + " DESC" * self.descending)
        if self.explicit:
            parts.append(f"ROWS BETWEEN {'UNBOUNDED' if self.back is None else self.back} PRECEDING AND CURRENT ROW")
        return "(" + " ".join(parts) + ")"


@dataclass(frozen=True)
class Aggregate:
    func: str
    arg: object
    distinct: bool = False
    over: Over | None = None

    def __str__(self) -> str:
        return f"{self.func}({'DISTINCT ' * self.distinct}{self.arg})" + (f" OVER {self.over}" if self.over else "")


# Conditions


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object  # Literal, or Name for a comparison of columns

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Between:
    left: Name
    low: Literal
    high: Literal
    negated: bool = False

    def __str__(self) -> str:
        return f"{self.left} {'NOT ' * self.negated}BETWEEN {self.low} AND {self.high}"


@dataclass(frozen=True)
class Among:
    left: Name
    values: tuple
    negated: bool = False

    def __str__(self) -> str:
        return f"{self.left} {'NOT ' * self.negated}IN ({', '.join(map(str, self.values))})"


@dataclass(frozen=True)
class AmongQuery:
    left: Name
    query: Select
    negated: bool = False

    def __str__(self) -> str:
        return f"{self.left} {'NOT ' * self.negated}IN ({self.query})"


@dataclass(frozen=True)
class IsNull:
    left: Name
    negated: bool = False

    def __str__(self) -> str:
        return f"{self.left} IS {'NOT ' * self.negated}NULL"


@dataclass(frozen=True)
class Both:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Either:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"


@dataclass(frozen=True)
class Negation:
    inner: object

    def __str__(self) -> str:
        return f"NOT {self.inner}"


# The query


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None

    @property
    def label(self) -> str:
        if self.alias:
            return self.alias
        return self.expr.name if isinstance(self.expr, Name) else str(self.expr)


@dataclass(frozen=True)
class Joined:
    source: str
    on: object = None
    outer: bool = False


@dataclass(frozen=True)
class Order:
    key: object  # a label, a position or an aggregate
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple
    source: str | None = None
    joins: tuple = ()
    where: object = None
    group: tuple = ()
    having: object = None
    order: tuple = ()
    limit: int | None = None
    distinct: bool = False
    aliases: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def sources(self) -> list[str]:
        return ([self.source] if self.source else []) + [j.source for j in self.joins]

    def __str__(self) -> str:
        out = "SELECT " + "DISTINCT " * self.distinct + ", ".join(str(i.expr) + (f" AS {i.alias}" if i.alias else "") for i in self.items)
        if self.source:
            out += f" FROM {self.source}" + "".join(f"{' LEFT' * j.outer} JOIN {j.source}" + (f" ON {j.on}" if j.on else "") for j in self.joins)
        if self.where:
            out += f" WHERE {self.where}"
        if self.group:
            out += " GROUP BY " + ", ".join(map(str, self.group))
        return out


def aggregates(expr) -> list[Aggregate]:
    """The aggregates in an expression, from left to right."""
    if isinstance(expr, Aggregate):
        return [expr]
    if isinstance(expr, Arithmetic):
        return aggregates(expr.left) + aggregates(expr.right)
    if isinstance(expr, (Compare, Both, Either)):
        return aggregates(expr.left) + aggregates(expr.right)
    return aggregates(expr.inner) if isinstance(expr, Negation) else []
