"""Statements that change tables: new files first, then a new manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import AnalysisError, ConstraintError
from corvane.plans import compiler
from corvane.plans.nodes import Assignment, Expr, Literal
from corvane.sources.catalog import Catalog, Table
from corvane.sources.delivered import read_csv
from corvane.types import literal_value, spark_type


def taken_message(key: object) -> str:
    return f"Insertion Error key: {key} is already in the index tree"


def check_row(table: Table, values: Sequence[Literal]) -> tuple:
    if len(values) != len(table.kinds):
        raise AnalysisError(f"VALIDATOR ERROR: table {table.name} has {len(table.kinds)} columns, not {len(values)}")
    return tuple(literal_value(v.text, k, c, store=True) for v, (c, k) in zip(values, table.kinds.items(), strict=True))


def insert(catalog: Catalog, table: Table, rows: Sequence[tuple]) -> list[str | None]:
    """Appends the rows whose keys are free, the first of equal keys; gives each row's error or None.

    The statement's own rows are the only ones that reach the driver; of the
    table only the keys asked for are looked up.
    """
    key = F.col(f"`{table.key}`")
    asked = sorted({r[0] for r in rows}, key=lambda k: k.encode() if isinstance(k, str) else k)
    there = table.between(asked[0], asked[-1]).df
    used = {r[0] for r in there.filter(key.isin(asked)).select(key).distinct().collect()}
    errors: list[str | None] = []
    fresh = []
    for row in rows:
        errors.append(taken_message(row[0]) if row[0] in used else None)
        if errors[-1] is None:
            fresh.append(row)
            used.add(row[0])
    if fresh:
        schema = T.StructType([T.StructField(c, spark_type(k)) for c, k in table.kinds.items()])
        new = catalog.write(table, catalog.spark.createDataFrame(fresh, schema).coalesce(1).sortWithinPartitions(key), sort=False)
        catalog.commit(table, table.files | new)
        catalog.compact(table.name)
    return errors


def load(catalog: Catalog, table: Table, path: str) -> tuple[int, DataFrame]:
    """Appends the good rows of CSV files; gives their number and the rejected lines.

    Of rows with equal keys the first delivered stays (one aggregation that
    combines before it shuffles, so no key is too frequent); rows whose key the
    table has already are left out.
    """
    good, rejects = read_csv(catalog.spark, path, table.kinds)
    return add_rows(catalog, table, good), rejects


def add_rows(catalog: Catalog, table: Table, rows: DataFrame) -> int:
    """Appends typed rows, one for each key that is not there yet; gives their number."""
    names = [f"`{c}`" for c in table.kinds]
    order = F.col("__at") if "__at" in rows.columns else F.struct(*names)
    first = rows.groupBy(names[0]).agg(F.min_by(F.struct(*names), order).alias("r")).select("r.*")
    new = catalog.write(table, first.join(table.df.select(names[0]), table.key, "left_anti"))
    catalog.commit(table, table.files | new)
    return catalog.read(table.kinds, list(new)).count()


def _matching(table: Table, where: Expr):
    scope = {table.name: table}
    return compiler.condition(where, scope)


def _rewrite(catalog: Catalog, table: Table, where: Expr, change) -> int:
    """Replaces the files that hold matching rows; gives the number of those rows.

    One pass finds the files (a list no longer than the table's) and counts.
    Files without a match are kept as they are.
    """
    whole, table = table, compiler.narrowed(table, where)
    cond = _matching(table, where)
    rows = compiler.qualified(table).filter(cond)
    located = table.df.select(
        *(F.col(f"`{c}`").alias(f"{table.name}.{c}") for c in table.kinds), F.col("_metadata.file_path").alias("__file")
    ) if table.files else rows.withColumn("__file", F.lit(""))
    counts = {r["__file"]: r["count"] for r in located.filter(cond).groupBy("__file").count().collect()}
    if not counts:
        return 0
    table = whole
    old = [f for f in table.files if f in counts]
    kept = {f: keys for f, keys in table.files.items() if f not in counts}
    part = replace(table, df=table.opened(old))
    after = change(compiler.qualified(part), cond).toDF(*table.kinds)
    new = catalog.write(table, after)
    catalog.commit(table, kept | new)
    return sum(counts.values())


def delete(catalog: Catalog, table: Table, where: Expr) -> int:
    return _rewrite(catalog, table, where, lambda rows, cond: rows.filter(~F.coalesce(cond, F.lit(False))))


def update(catalog: Catalog, table: Table, assignments: Sequence[Assignment], where: Expr) -> int:
    scope = {table.name: table}
    new = {}
    for a in assignments:
        owner, kind = compiler.resolve(a.target, scope)
        if a.target.column in new:
            raise AnalysisError(f"VALIDATOR ERROR: column {a.target.column} is set twice")
        if a.op is None:
            value = F.lit(literal_value(a.value.text, kind, a.target.column, store=True))
        else:
            _, source_kind = compiler.resolve(a.source, scope)
            if kind != "int" or source_kind != "int":
                raise AnalysisError("VALIDATOR ERROR: only int columns are computed")
            source, number = compiler.column(owner, a.source.column), int(a.value.text)
            if a.op in "/%" and number == 0:
                raise AnalysisError("VALIDATOR ERROR: division by zero")
            steps = {"+": source + number, "-": source - number, "*": source * number, "%": source % number}
            value = F.expr(f"`{owner}.{a.source.column}` div {number}") if a.op == "/" else steps[a.op]
        new[a.target.column] = value.cast(spark_type(kind))
    if table.key in new:
        _check_keys(table, where, new[table.key])

    def change(rows: DataFrame, cond) -> DataFrame:
        cols = [
            F.when(cond, new[c]).otherwise(compiler.column(table.name, c)).alias(c)
            if c in new
            else compiler.column(table.name, c).alias(c)
            for c in table.kinds
        ]
        return rows.select(*cols)

    return _rewrite(catalog, table, where, change)


def _check_keys(table: Table, where: Expr, value) -> None:
    """Fails if two rows would have one key. Only the new keys are counted, and looked up among those that stay."""
    key = compiler.column(table.name, table.key)
    matching = F.coalesce(_matching(table, where), F.lit(False))
    rows = compiler.qualified(table)
    changed = rows.filter(matching).select(value.alias("k"))
    same = changed.groupBy("k").count().filter("count > 1")
    taken = changed.join(rows.filter(~matching).select(key.alias("k")), "k", "left_semi").withColumn("count", F.lit(1).cast("long"))
    twice = same.unionByName(taken).head(1)
    if twice:
        raise ConstraintError(taken_message(twice[0]["k"]))
