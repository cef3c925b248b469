"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this many rows ...
HOT_ROWS = 1_000_000
#: ... and is among so many of the most frequent ones, which bounds the list. Its error in the frequency sketch is a few
#: ten-thousandths of all rows, which the sizes of a cluster's tasks do not fall below.
TRACKED = 10_000


def hot_keys(df: DataFrame, key: str, *, hot_rows: int = HOT_ROWS) -> list[tuple[object, int]]:
    """Keys holding at least ``hot_rows`` rows, with their row counts.

    One column is read and summarised by a mergeable frequent-items sketch, so
    nothing is shuffled by key. Every key the sketch tracks can qualify, at most
    TRACKED. Nulls are not keys. An empty input has no hot keys.
    """
    top = F.expr(f"approx_top_k(`{key}`, {TRACKED}, {TRACKED})").alias("top")
    got = df.filter(F.col(key).isNotNull()).agg(top).first()
    return [(x["item"], x["count"]) for x in got["top"] or [] if x["item"] is not None and x["count"] >= hot_rows]


def hottest(counts: DataFrame, key: str, *, hot_rows: int = HOT_ROWS) -> list[tuple[object, int]]:
    """`hot_keys` from exact counts ``(key, n)``: the TRACKED most frequent keys with at least ``hot_rows`` rows."""
    most = counts.filter((F.col("n") >= hot_rows) & F.col(key).isNotNull()).orderBy(F.desc("n")).limit(TRACKED)
    return [(r[key], r["n"]) for r in most.select(key, "n").collect()]


def salted_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str,
    spread: Column,
    *,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    hot: list[tuple[object, int]] | None = None,
) -> DataFrame:
    """Equi-join ``facts`` with ``dims`` on ``key``, splitting hot fact keys over several tasks.

    ``dims`` has few rows per key; ``spread`` is an expression over ``facts``
    whose hash scatters one key's rows. Rows of a hot key get a salt and its
    dims rows are repeated once for each salt, so no task sees more than about
    ``hot_rows`` fact rows of one key. Keys that are not hot have salt 0. Null
    fact keys match nothing and are scattered too. A small ``dims`` is still
    broadcast by adaptive execution, which knows its real size by then. ``hot``
    gives the result of `hot_keys` where ``facts`` is costly to compute twice.
    """
    if hot is None:
        hot = hot_keys(facts, key, hot_rows=hot_rows)
    scattered = (F.pmod(F.xxhash64(spread), F.lit(997)) + 1).cast("int")
    if not hot:
        left = facts.withColumn("__salt", F.when(F.col(key).isNull(), scattered).otherwise(0))
        right = dims.withColumn("__salt", F.lit(0))
        return left.join(right, [key, "__salt"], how).drop("__salt")
    kind = facts.schema[key].dataType.simpleString()
    rows = [(k, math.ceil(n / hot_rows) + 1) for k, n in hot]
    plan = F.broadcast(facts.sparkSession.createDataFrame(rows, f"`{key}` {kind}, __salts int"))  # at most TRACKED rows
    left = (
        facts.withColumn("__spread", F.xxhash64(spread))
        .join(plan, key, "left")
        .withColumn(
            "__salt",
            F.when(F.col(key).isNull(), (F.pmod("__spread", F.lit(997)) + 1).cast("int")).otherwise(
                F.coalesce(F.pmod(F.col("__spread"), F.col("__salts").cast("long")).cast("int"), F.lit(0))
            ),
        )
        .drop("__salts", "__spread")
    )
    right = (
        dims.join(plan, key, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
        .drop("__salts")
    )
    return left.join(right, [key, "__salt"], how).drop("__salt")
