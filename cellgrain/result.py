"""What a query returns: a lazy DataFrame, with small conveniences for results that fit the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class ResultSet:
    """``df`` is the distributed result. Rows are fetched once, in the query's order or else by the positions of group keys.

    ``in_order`` gives the result so ordered, where ``df`` itself has no order.
    """

    def __init__(self, df: DataFrame, in_order: Callable[[], DataFrame] | None = None, stats: dict | None = None):
        self.df, self._in_order, self.stats = df, in_order, dict(stats or {})
        self._rows: list[tuple] | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def ordered(self) -> DataFrame:
        return self._in_order() if self._in_order else self.df

    @property
    def rows(self) -> list[tuple]:
        if self._rows is None:
            began = time.perf_counter()
            self._rows = [tuple(r) for r in self.ordered().collect()]
            self.stats["compute_seconds"] = time.perf_counter() - began
            self.stats["total_seconds"] = self.stats.get("compile_seconds", 0.0) + self.stats["compute_seconds"]
        return self._rows

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i):
        return self.rows[i]

    def column(self, name: str) -> list:
        if name not in self.columns:
            raise KeyError(f"no column {name!r}; there are {', '.join(self.columns)}")
        i = self.columns.index(name)
        return [r[i] for r in self.rows]

    def to_dicts(self) -> list[dict]:
        return [dict(zip(self.columns, r)) for r in self.rows]

    def to_pandas(self):
        return self.ordered().toPandas()

    def to_text(self, max_rows: int = 50, float_fmt: str = "{:.6g}") -> str:
        """An aligned table of the first rows; only those are fetched."""
        some = self._rows if self._rows is not None else [tuple(r) for r in self.ordered().limit(max_rows + 1).collect()]
        shown = [["NULL" if v is None else float_fmt.format(v) if isinstance(v, float) else str(v) for v in r] for r in some[:max_rows]]
        widths = [max([len(c), *(len(r[i]) for r in shown)]) for i, c in enumerate(self.columns)]
        line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip()
        total = len(some) if len(some) <= max_rows else self.df.count() if self._rows is None else len(self._rows)
        out = [line(self.columns), line(["-" * w for w in widths]), *map(line, shown)]
        if total > max_rows:
            out.append(f"... {total - max_rows} more")
        return "\n".join([*out, f"({total} rows)"])

    __str__ = to_text
