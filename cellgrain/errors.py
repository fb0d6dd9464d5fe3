"""Errors that a query or the catalog can raise."""

from __future__ import annotations


class QuerySyntaxError(ValueError):
    """The text is no query; shows the line with a caret below the place."""

    def __init__(self, message: str, text: str = "", at: int = 0):
        self.line = text.count("\n", 0, at) + 1
        self.column = at - (text.rfind("\n", 0, at) + 1) + 1
        shown = text.split("\n")[self.line - 1] if text else ""
        super().__init__(f"{message} (line {self.line}, column {self.column})" + (f"\n{shown}\n{' ' * (self.column - 1)}^" if shown else ""))


class BindError(ValueError):
    """Names or shapes in a query don't fit the catalog."""


class AccessDenied(PermissionError):
    """A role may not do this."""


class TooManyIndicesError(ValueError):
    """A specification has more axes than it has letters."""
