"""Checked statements to DataFrames.

Names are resolved before Spark sees them: they are case-sensitive, and a
column without a table belongs to the first table listed.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import AnalysisError, PlanError
from corvane.plans.nodes import Compare, Expr, Literal, Logic, Name
from corvane.sources.catalog import Table
from corvane.types import family, literal_value

_OPS = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
}
Scope = Mapping[str, Table]


def resolve(name: Name, scope: Scope) -> tuple[str, str]:
    """Table and type of a column name."""
    table = name.table or next(iter(scope))
    if table not in scope:
        raise AnalysisError(f"VALIDATOR ERROR: table {table} is not part of the statement")
    kinds = scope[table].kinds
    if name.column not in kinds:
        raise AnalysisError(f"VALIDATOR ERROR: column {name.column} does not exist in table {table}")
    return table, kinds[name.column]


def column(table: str, name: str) -> Column:
    return F.col(f"`{table}.{name}`")


def tables_of(expr: Expr, scope: Scope) -> set[str]:
    if isinstance(expr, Logic):
        return tables_of(expr.left, scope) | tables_of(expr.right, scope)
    return {resolve(x, scope)[0] for x in (expr.left, expr.right) if isinstance(x, Name)}


def condition(expr: Expr, scope: Scope) -> Column:
    """The boolean column of an expression, with types checked."""
    if isinstance(expr, Logic):
        left, right = condition(expr.left, scope), condition(expr.right, scope)
        return left & right if expr.op == "and" else left | right
    return _comparison(expr, scope)


def _comparison(expr: Compare, scope: Scope) -> Column:
    sides = (expr.left, expr.right)
    names = [resolve(x, scope) for x in sides if isinstance(x, Name)]
    if not names:
        raise AnalysisError("VALIDATOR ERROR: a comparison needs a column")
    kinds = {family(kind) for _, kind in names}
    if len(kinds) > 1:
        raise AnalysisError(f"VALIDATOR ERROR: cannot compare {' with '.join(sorted(kinds))}")
    if "bool" in kinds and expr.op not in ("==", "!="):
        raise AnalysisError("VALIDATOR ERROR: booleans have no order")

    def side(x: Name | Literal) -> Column:
        if isinstance(x, Name):
            return column(resolve(x, scope)[0], x.column)
        named = next(y for y in sides if isinstance(y, Name))
        return F.lit(literal_value(x.text, names[0][1], named.column))

    return _OPS[expr.op](side(expr.left), side(expr.right))


def _conjuncts(expr: Expr | None) -> list[Expr]:
    if expr is None:
        return []
    if isinstance(expr, Logic) and expr.op == "and":
        return _conjuncts(expr.left) + _conjuncts(expr.right)
    return [expr]


_MIRRORED = {"==": "==", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def narrowed(table: Table, where: Expr | None) -> Table:
    """A stored table without files in which no key meets the conditions on it that must all hold."""
    low = high = None
    order = lambda x: x.encode() if isinstance(x, str) else x
    for e in _conjuncts(where) if table.stored else ():
        if not isinstance(e, Compare) or e.op not in _MIRRORED:
            continue
        name, literal, op = e.left, e.right, e.op
        if isinstance(name, Literal):
            name, literal, op = literal, name, _MIRRORED[op]
        if isinstance(literal, Name) or name.column != table.key or name.table not in (None, table.name):
            continue
        value = literal_value(literal.text, table.kinds[table.key], name.column)
        if op in ("==", ">", ">=") and (low is None or order(value) > order(low)):
            low = value
        if op in ("==", "<", "<=") and (high is None or order(value) < order(high)):
            high = value
    return table if low is None and high is None else table.between(low, high)


def qualified(table: Table) -> DataFrame:
    """The table's rows, each column named ``table.column``."""
    return table.df.select(*(F.col(f"`{c}`").alias(f"{table.name}.{c}") for c in table.kinds))


def select(tables: Sequence[Table], where: Expr | None) -> DataFrame:
    """The rows of the joined tables for which ``where`` holds, columns in the order of the tables.

    Conditions on one table are filters of its scan. From the first table on,
    the next table is one that a comparison links to those joined already
    (an equality before any other); all links at hand become its join
    condition. A table without a link would make a cross product and is refused.
    Physical joins and their order are left to Spark.
    """
    scope = {t.name: t for t in tables}
    if len(scope) < len(tables):
        raise AnalysisError("VALIDATOR ERROR: a table is listed twice")
    open_ = [(e, tables_of(e, scope), condition(e, scope)) for e in _conjuncts(where)]
    frames = {}
    for t in tables:
        mine = [e for e, used, _ in open_ if used == {t.name}]
        for e in mine:
            t = narrowed(t, e)
        frame = qualified(t)
        for _, used, cond in open_:
            if used == {t.name}:
                frame = frame.filter(cond)
        frames[t.name] = frame
    open_ = [x for x in open_ if len(x[1]) > 1]

    joined = {tables[0].name}
    result = frames[tables[0].name]
    rest = [t.name for t in tables[1:]]
    while rest:
        links = {
            name: [x for x in open_ if isinstance(x[0], Compare) and name in x[1] and x[1] <= joined | {name}]
            for name in rest
        }
        linked = [n for n in rest if links[n]]
        if not linked:
            raise PlanError(f"no comparison links {', '.join(rest)} to the other tables")
        name = min(linked, key=lambda n: not any(x[0].op == "==" for x in links[n]))
        cond = None
        for x in links[name]:
            cond = x[2] if cond is None else cond & x[2]
            open_.remove(x)
        result = result.join(frames[name], cond, "inner")
        joined.add(name)
        rest.remove(name)
    for _, _, cond in open_:
        result = result.filter(cond)
    return result.select(*(column(t.name, c) for t in tables for c in t.kinds))


def bare_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns' table names left off where the rest is unique."""
    short = [c.split(".", 1)[1] for c in df.columns]
    keep = [s if short.count(s) == 1 else c for s, c in zip(short, df.columns, strict=True)]
    return df.toDF(*keep)
