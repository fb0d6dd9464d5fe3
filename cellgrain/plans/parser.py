"""From query text to ``nodes.Select``.

One regular expression splits the text; a recursive-descent parser reads the tokens. Names may hold
any letters; keywords are matched in any case and must be double-quoted to serve as names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QuerySyntaxError
from . import nodes as n

KEYWORDS = frozenset(
    "SELECT DISTINCT FROM JOIN INNER LEFT OUTER ON WHERE GROUP BY HAVING ORDER LIMIT AS AND OR NOT IN IS NULL BETWEEN ASC DESC "
    "SUM AVG COUNT MIN MAX OVER PARTITION ROWS RANGE UNBOUNDED PRECEDING CURRENT ROW FOLLOWING CASE WHEN THEN ELSE END".split()
)
FUNCTIONS = ("SUM", "AVG", "COUNT", "MIN", "MAX")
COMPARISONS = ("=", "!=", "<>", "<", "<=", ">", ">=")

_LEXEME = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
      | (?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<word>[^\W\d]\w*)
      | (?P<sign><>|!=|<=|>=|[=<>+\-*/(),.;])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, keyword, sign or end
    value: object
    at: int


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise QuerySyntaxError("unclosed string" if text[at] in "'\"" else f"unexpected character {text[at]!r}", text, at)
        kind, value = m.lastgroup, m.group()
        if kind == "number":
            out.append(Token("number", float(value) if re.search(r"[.eE]", value) else int(value), at))
        elif kind == "string":
            out.append(Token("string", value[1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token("name", value[1:-1].replace('""', '"'), at))
        elif kind == "word":
            out.append(Token("keyword", value.upper(), at) if value.upper() in KEYWORDS else Token("name", value, at))
        elif kind == "sign":
            out.append(Token("sign", "!=" if value == "<>" else value, at))
        at = m.end()
    return [*out, Token("end", None, len(text))]


def parse(text: str) -> n.Select:
    reader = _Reader(text)
    query = reader.select()
    reader.accept(";")
    if reader.now.kind != "end":
        reader.fail("text after the query")
    return query


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, message: str):
        found = "the end" if self.now.kind == "end" else repr(self.now.value)
        raise QuerySyntaxError(f"{message}, found {found}", self.text, self.now.at)

    def accept(self, *words: str) -> bool:
        """Take these keywords or signs if they come next."""
        for k, w in enumerate(words):
            t = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if t.kind not in ("keyword", "sign") or t.value != w:
                return False
        self.i += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.accept(*words):
            self.fail(f"expected {' '.join(words)}")

    def name(self, what: str = "a name") -> str:
        if self.now.kind != "name":
            self.fail(f"expected {what}")
        self.i += 1
        return self.tokens[self.i - 1].value

    def column(self) -> n.Name:
        first = self.name("a column")
        return n.Name(self.name(), first) if self.accept(".") else n.Name(first)

    def many(self, one) -> tuple:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return tuple(out)

    # select

    def select(self) -> n.Select:
        self.need("SELECT")
        distinct = self.accept("DISTINCT")
        start = self.i
        items = self.many(self.item)
        source, joins, aliases = None, [], {}
        if self.accept("FROM"):
            source = self.source(aliases)
            while (outer := self.accept("LEFT")) or self.accept("INNER") or self.now.value == "JOIN" and self.now.kind == "keyword":
                if outer:
                    self.accept("OUTER")
                self.need("JOIN")
                joined = self.source(aliases)
                joins.append(n.Joined(joined, self.condition() if self.accept("ON") else None, outer))
        where = self.condition() if self.accept("WHERE") else None
        group = self.many(self.column) if self.accept("GROUP", "BY") else ()
        having = self.condition() if self.accept("HAVING") else None
        order = self.many(self.order) if self.accept("ORDER", "BY") else ()
        limit = None
        if self.accept("LIMIT"):
            if self.now.kind != "number" or not isinstance(self.now.value, int):
                self.fail("expected a whole number")
            limit = self.now.value
            self.i += 1
        if distinct:
            if group or any(n.aggregates(i.expr) for i in items):
                self.i = start
                self.fail("DISTINCT goes with neither GROUP BY nor aggregates")
            if not all(isinstance(i.expr, n.Name) for i in items):
                self.i = start
                self.fail("DISTINCT takes columns")
            group = tuple(i.expr for i in items)
        return n.Select(items, source, tuple(joins), where, group, having, order, limit, distinct, aliases)

    def source(self, aliases: dict) -> str:
        name = self.name("a source")
        if self.accept("AS"):
            aliases[self.name("an alias")] = name
        elif self.now.kind == "name":
            aliases[self.name()] = name
        return name

    def item(self) -> n.Item:
        if self.accept("*"):
            return n.Item(n.Star())
        expr = self.sum()
        if self.accept("AS"):
            return n.Item(expr, self.name("an alias"))
        return n.Item(expr, self.name() if self.now.kind == "name" else None)

    def order(self) -> n.Order:
        if self.now.kind == "number":
            key = n.Literal(self.now.value)
            self.i += 1
        else:
            key = self.primary()
        descending = self.accept("DESC")
        if not descending:
            self.accept("ASC")
        return n.Order(key, descending)

    # expressions

    def sum(self):
        left = self.product()
        while self.now.kind == "sign" and self.now.value in "+-":
            op = self.now.value
            self.i += 1
            left = n.Arithmetic(op, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.now.kind == "sign" and self.now.value in ("*", "/"):
            op = self.now.value
            self.i += 1
            left = n.Arithmetic(op, left, self.unary())
        return left

    def unary(self):
        if self.accept("-"):
            inner = self.unary()
            return n.Literal(-inner.value) if isinstance(inner, n.Literal) and not isinstance(inner.value, str) else n.Arithmetic("*", n.Literal(-1), inner)
        self.accept("+")
        return self.primary()

    def primary(self):
        t = self.now
        if t.kind in ("number", "string"):
            self.i += 1
            return n.Literal(t.value)
        if self.accept("("):
            inner = self.sum()
            self.need(")")
            return inner
        if t.kind == "keyword" and t.value in FUNCTIONS:
            return self.aggregate()
        if self.accept("CASE"):
            return self.case()
        if t.kind == "name":
            return self.column()
        self.fail("expected an expression")

    def aggregate(self) -> n.Aggregate:
        func = self.now.value
        self.i += 1
        self.need("(")
        distinct = self.accept("DISTINCT")
        arg = n.Star() if self.accept("*") else self.sum()
        self.need(")")
        return n.Aggregate(func, arg, distinct, self.over() if self.accept("OVER") else None)

    def over(self) -> n.Over:
        self.need("(")
        partition = self.many(self.column) if self.accept("PARTITION", "BY") else ()
        order, descending, back, explicit = None, False, None, False
        if self.accept("ORDER", "BY"):
            order = self.column()
            descending = self.accept("DESC")
            if not descending:
                self.accept("ASC")
        if self.accept("ROWS") or self.accept("RANGE"):
            explicit = True
            self.need("BETWEEN")
            if not self.accept("UNBOUNDED"):
                if self.now.kind != "number" or not isinstance(self.now.value, int):
                    self.fail("a frame starts at UNBOUNDED or a number PRECEDING")
                back = self.now.value
                self.i += 1
            self.need("PRECEDING")
            self.need("AND")
            self.need("CURRENT", "ROW")
        self.need(")")
        return n.Over(partition, order, descending, back, explicit)

    def case(self) -> n.Case:
        branches = []
        while self.accept("WHEN"):
            condition = self.condition()
            self.need("THEN")
            branches.append((condition, self.sum()))
        if not branches:
            self.fail("CASE needs WHEN")
        otherwise = self.sum() if self.accept("ELSE") else None
        self.need("END")
        return n.Case(tuple(branches), otherwise)

    # conditions

    def condition(self):
        left = self.conjunction()
        while self.accept("OR"):
            left = n.Either(left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.accept("AND"):
            left = n.Both(left, self.negation())
        return left

    def negation(self):
        return n.Negation(self.negation()) if self.accept("NOT") else self.predicate()

    def predicate(self):
        if self.now.kind == "sign" and self.now.value == "(":
            back = self.i
            self.i += 1
            try:
                inner = self.condition()
                self.need(")")
                return inner
            except QuerySyntaxError:  # the parenthesis may open an expression
                self.i = back
        left = self.sum() if self.now.kind == "keyword" and self.now.value in FUNCTIONS else self.column()
        if self.accept("IS"):
            negated = self.accept("NOT")
            self.need("NULL")
            return n.IsNull(left, negated)
        negated = self.accept("NOT")
        if self.accept("IN"):
            self.need("(")
            if self.now.kind == "keyword" and self.now.value == "SELECT":
                out = n.AmongQuery(left, self.select(), negated)
            else:
                out = n.Among(left, self.many(self.value), negated)
            self.need(")")
            return out
        if self.accept("BETWEEN"):
            low = self.value()
            self.need("AND")
            return n.Between(left, low, self.value(), negated)
        if negated or self.now.kind != "sign" or self.now.value not in COMPARISONS:
            self.fail("expected a comparison")
        op = self.now.value
        self.i += 1
        return n.Compare(op, left, self.value(True))

    def value(self, columns: bool = False):
        """A literal; a bare name is a string, a qualified one a column."""
        sign = -1 if self.accept("-") else 1
        if sign == 1:
            self.accept("+")
        t = self.now
        if t.kind == "number":
            self.i += 1
            return n.Literal(sign * t.value)
        if t.kind == "string" and sign == 1:
            self.i += 1
            return n.Literal(t.value)
        if t.kind == "name" and sign == 1:
            name = self.column()
            if name.qualifier is None:
                return n.Literal(name.name)
            if columns:
                return name
        self.fail("expected a value")
