"""Percentiles of very large numeric columns, by radix selection.

Values become order-preserving integers. A histogram of the leading digit is
counted per group and period; the digit that holds each wanted rank is followed
and the next digit is counted among the values that share it, until no digits
are left. Histograms of separate periods are added to combine them. Each pass
is one aggregation with at most 65,536 buckets for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.storage import materialise

DIGIT = 16
#: Rows of targets up to which they are broadcast.
SMALL = 50_000
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": 64, "double": 64}
_MANTISSA = 52


@F.pandas_udf(T.LongType())
def _float_code(x: pd.Series) -> pd.Series:
    bits = (x.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.pandas_udf(T.DoubleType())
def _float_of(code: pd.Series) -> pd.Series:
    c = code.to_numpy(np.int64)
    return pd.Series(np.where(c < 0, c ^ np.int64(2**63 - 1), c).view(np.float64))


def _kind(df: DataFrame, value: str) -> str:
    kind = df.schema[value].dataType.simpleString()
    if kind not in _BITS:
        raise TypeError(f"{value} must be an integer or a float column, not {kind}")
    return kind


def ordered_code(value: Column, kind: str) -> Column:
    """A bigint in the order of the values. -0.0 equals 0.0."""
    return _float_code(value.cast("double")) if kind in ("float", "double") else value.cast("bigint")


def _decode(code: Column, kind: str) -> Column:
    return _float_of(code).cast(kind) if kind in ("float", "double") else code.cast(kind)


def _codes(df: DataFrame, value: str, groups: Sequence[str], period: Column | None, kind: str) -> DataFrame:
    ok = F.col(value).isNotNull() & (~F.isnan(value) if kind in ("float", "double") else F.lit(True))
    return df.filter(ok).select(
        F.struct(*(F.col(g).alias(f"g{i}") for i, g in enumerate(groups)), F.lit(0).alias("all")).alias("g"),
        (F.lit(None).cast("string") if period is None else period.cast("string")).alias("period"),
        ordered_code(F.col(value), kind).alias("code"),
    )


def digit_histogram(codes: DataFrame, shift: int, targets: DataFrame | None = None, upper: int = 64) -> DataFrame:
    """``(g, parent, period, prefix, n)``: counts of the codes' leading bits down to ``shift``.

    With ``targets`` ``(g, parent)`` only codes whose bits down to ``upper``
    are such a parent. Histograms of the same shift add up, over periods,
    partitions or days.
    """
    rows = codes.select("g", "period", F.shiftright("code", shift).alias("prefix"))
    if targets is None:
        rows = rows.withColumn("parent", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("parent", F.shiftright("prefix", upper - shift)).join(targets, ["g", "parent"], "left_semi")
    return rows.groupBy("g", "parent", "period", "prefix").agg(F.count(F.lit(1)).alias("n"))


def _follow(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(g, p, n_all, rank, prefix)``: the bucket that holds each wanted rank, and the rank inside it."""
    merged = histogram.groupBy("g", "parent", "prefix").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("g", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    buckets = merged.withColumn("upto", F.sum("n").over(upto))
    held = buckets.join(wanted, ["g", "parent"]).filter("rank > upto - n and rank <= upto")
    return held.select("g", "p", "n_all", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "prefix")


def _wanted(totals: DataFrame, ps: Sequence[float]) -> DataFrame:
    # nearest rank: the smallest value with at least p * n values up to it
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("p") * F.col("n_all")))
    return (
        totals.select("g", "n_all", F.explode(F.array(*(F.lit(float(p)) for p in ps))).alias("p"))
        .withColumn("rank", rank)
        .withColumn("parent", F.lit(0).cast("long"))
    )


def _shape(found: DataFrame, groups: Sequence[str], ps: Sequence[float], names: Sequence[str], cells: dict[str, Column]) -> DataFrame:
    at = lambda p, c: F.max(F.when(F.col("p") == float(p), c))
    wide = found.groupBy("g").agg(
        F.max("n_all").alias("n"),
        *(at(p, c).alias(name + end) for p, name in zip(ps, names, strict=True) for end, c in cells.items()),
    )
    return wide.select(*(F.col(f"g.g{i}").alias(g) for i, g in enumerate(groups)), *(c for c in wide.columns if c != "g"))


def _names(ps: Sequence[float]) -> list[str]:
    return [f"p{100 * p:g}".replace(".", "_") for p in ps]


def radix_percentiles(
    df: DataFrame, value: str, groups: Sequence[str], ps: Sequence[float], *, period: Column | None = None
) -> DataFrame:
    """Exact percentiles of ``value`` for each group: the error bound is zero.

    Returns the group columns, ``n`` and one column for each percentile (``p50``,
    ``p99_9``). The percentile p of n values is the value of rank ceil(p * n)
    (at least 1), so it is always one of the values. Nulls and NaN are left out;
    a group without other values does not appear, and an empty input gives an
    empty result. A null group is a group. Ties and repeated rows count as they
    stand. ``period`` keeps the first histogram apart by period, as separate
    runs would make it; the sums are the same.

    The codes are written once; each of the passes (one for 16 bits, two for an
    int, four for a bigint or float) reads them and shuffles only counts. A
    group of any size is spread over all tasks, since what is combined is counts
    of at most 65,536 digits for each group and followed prefix.
    """
    kind = _kind(df, value)
    codes = materialise(_codes(df, value, groups, period, kind), "codes")
    width = _BITS[kind]
    shifts = list(range(max(0, width - DIGIT), -1, -DIGIT))
    first = materialise(digit_histogram(codes, shifts[0]), "digits")
    wanted = _wanted(first.groupBy("g").agg(F.sum("n").alias("n_all")), ps)
    found = _follow(first, wanted)
    for upper, shift in zip(shifts, shifts[1:], strict=False):
        found = materialise(found.withColumnRenamed("prefix", "parent"), "ranks")
        targets = found.select("g", "parent").distinct()
        if found.count() <= SMALL:
            targets = F.broadcast(targets)
        found = _follow(digit_histogram(codes, shift, targets, upper), found)
    return _shape(found, groups, ps, _names(ps), {"": _decode(F.col("prefix"), kind)})


def sketch(df: DataFrame, value: str, groups: Sequence[str], *, period: Column | None = None, bits: int = 7) -> DataFrame:
    """A mergeable histogram of ``value`` by group and period, with a relative error of 2**-bits.

    Returns ``(g, parent, period, prefix, n)``; the value is taken as a double
    and its code cut after ``bits`` bits of the mantissa, so a bucket spans at
    most 2**-bits of its lower end (for subnormal values and zero, a bucket is
    exact or narrower than 2**-1022). Sketches of separate partitions, days or
    months are combined by `combine`.
    """
    _kind(df, value)
    doubles = df.withColumn("__value", F.col(value).cast("double"))
    codes = _codes(doubles, "__value", groups, period, "double")
    return digit_histogram(codes, _MANTISSA - bits)


def combine(*sketches: DataFrame) -> DataFrame:
    """One sketch of everything that went into ``sketches``, all made with the same bits."""
    rows = sketches[0]
    for more in sketches[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("g", "parent", F.lit(None).cast("string").alias("period"), "prefix").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketched: DataFrame, groups: Sequence[str], ps: Sequence[float], *, bits: int = 7) -> DataFrame:
    """Bounds of the percentiles: group columns, ``n``, ``<p>_low`` and ``<p>_high``.

    The exact percentile (by rank ceil(p * n)) lies between the two, ends
    included, which differ by at most 2**-bits of the lower one in size.
    """
    shift = _MANTISSA - bits
    wanted = _wanted(sketched.groupBy("g").agg(F.sum("n").alias("n_all")), ps)
    found = _follow(sketched, wanted)
    low = F.shiftleft("prefix", shift)
    found = found.withColumn("low", _float_of(low)).withColumn("high", _float_of(low + F.lit(2**shift - 1)))
    return _shape(found, groups, ps, _names(ps), {"_low": F.col("low"), "_high": F.col("high")})
