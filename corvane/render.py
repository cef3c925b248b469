"""Results as text for a console."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.session import StatementResult

#: Rows shown at most; the count below them is always of all rows, and what is left out is said.
SHOWN = 1000


def _box(header: list[str], rows: list[list[str]]) -> str:
    widths = [max(map(len, col)) for col in zip(header, *rows, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    return "\n".join([rule, line(header), rule, *map(line, rows), *([rule] if rows else [])])


def _cell(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def render(result: DataFrame | StatementResult | list, shown: int = SHOWN) -> str:
    """A boxed table with its number of records, or a statement's message."""
    if isinstance(result, list):
        return "\n".join(render(r, shown) for r in result)
    if isinstance(result, StatementResult):
        return result.message
    rows = [list(map(_cell, r)) for r in result.take(shown)]
    if result.columns == ["table", "column", "type", "indexed"]:
        if not rows:
            return "No tables."
        return "\n".join(f"{t}.{c} {k} {'[indexed]' if i == 'true' else '[no-index]'}" for t, c, k, i in rows)
    n = len(rows) if len(rows) < shown else result.count()
    left = f"\n{n - len(rows)} more records are not shown." if n > len(rows) else ""
    return f"{_box(result.columns, rows)}{left}\nReturned {n} records."
