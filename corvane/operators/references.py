"""References to records that do not exist.

Every change of a referenced table is a signed delta of its key's existence
count: +1 when a record appears, -1 when it goes. Every referring record is a
+1 (or, when withdrawn, -1) of the key's reference count. A key is an orphan
where references are positive while existence is zero: now (`current_orphans`,
kept up to date by `apply_deltas`) or at the moment of each reference, where
both kinds of deltas are summed up in the order of time (`orphan_references`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.skew import HOT_ROWS, hot_keys, hottest
from corvane.storage import materialise


@dataclass(frozen=True)
class Reference:
    """Column ``column`` of the referring table names records ``key`` of ``table``."""

    name: str
    column: str
    table: DataFrame
    key: str
    created: str = "created_at"
    deleted: str = "deleted_at"


def existence_deltas(ref: Reference) -> DataFrame:
    """``(ref_table, key, at, refs, exists, always)``: the table's rows as signed existence deltas.

    A null creation time stands for the beginning of time, a null deletion time
    for never. A row deleted at or before its creation never exists and gives no
    deltas; neither does a row with a null key. Rows delivered twice count
    twice in both directions, so their sums stay consistent.
    """
    t = ref.table.select(
        F.col(ref.key).alias("key"), F.col(ref.created).alias("a"), F.col(ref.deleted).alias("b")
    ).filter("key is not null and (a is null or b is null or a < b)")
    always = (F.col("a").isNull() & F.col("b").isNull()).cast("long")
    start = F.lit("0001-01-01 00:00:00").cast(t.schema["a"].dataType)
    born = F.struct(F.coalesce("a", start).alias("at"), F.lit(1).cast("long").alias("exists"), always.alias("always"))
    gone = F.struct(F.col("b").alias("at"), F.lit(-1).cast("long").alias("exists"), F.lit(0).cast("long").alias("always"))
    return (
        t.select("key", F.explode(F.array(born, gone)).alias("d"))
        .filter("d.at is not null")
        .select(F.lit(ref.name).alias("ref_table"), "key", "d.at", F.lit(0).cast("long").alias("refs"), "d.exists", "d.always")
    )


def reference_deltas(facts: DataFrame, ref: Reference, at: str, ident: str | None = None) -> DataFrame:
    """``(ref_table, key, at, refs, exists)``: each referring record as +1 reference of its key; with ``ident``, its ``id`` too."""
    more = [] if ident is None else [F.col(ident).alias("id")]
    return facts.filter(F.col(ref.column).isNotNull()).select(
        F.lit(ref.name).alias("ref_table"),
        F.col(ref.column).alias("key"),
        F.col(at).alias("at"),
        F.lit(1).cast("long").alias("refs"),
        F.lit(0).cast("long").alias("exists"),
        *more,
    )


def apply_deltas(ledger: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The ledger ``(ref_table, key, refs, exists)`` after ``deltas``.

    Sums are associative: batches can be applied in any order and split in any
    way. Keys whose counts both return to zero leave the ledger.
    """
    cols = ["ref_table", "key", "refs", "exists"]
    rows = deltas.select(*cols) if ledger is None else ledger.select(*cols).unionByName(deltas.select(*cols))
    return (
        rows.groupBy("ref_table", "key")
        .agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))
        .filter("refs <> 0 or exists <> 0")
    )


def current_orphans(ledger: DataFrame) -> DataFrame:
    """Keys with positive references and no existence: ``(ref_table, key, refs)``."""
    return ledger.filter("refs > 0 and exists <= 0").select("ref_table", "key", "refs")


# In the order of a key's deltas: sums carried over from earlier slices, what holds at all times, and what has a time.
# Of deltas at one time, existence comes before references.
_CARRIED, _ALWAYS, _TIMED = 0, 1, 2


def _folded(ref: Reference) -> DataFrame:
    """``(key, phase, at, exists)``: existence deltas, those of one key and time in one row, so repeated rows add none."""
    deltas = existence_deltas(ref)
    always = deltas.filter("always > 0").withColumn("at", F.lit(None).cast(deltas.schema["at"].dataType))
    timed = deltas.filter("always = 0").withColumn("phase", F.lit(_TIMED))
    rows = always.withColumn("phase", F.lit(_ALWAYS)).unionByName(timed)
    return rows.groupBy("key", "phase", "at").agg(F.sum("exists").alias("exists")).filter("exists <> 0")


def _sliced(deltas: DataFrame, refs: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``slice``: the changes of a key with very many are cut into ranges of time, each begun by the sum before it."""
    sizes = deltas.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    busy = [k for k, _ in hottest(sizes, "key", hot_rows=hot_rows)]
    whole = F.lit(0).alias("slice")
    if not busy:
        return deltas.select("*", whole), refs.select("*", whole)
    parts = math.ceil(sizes.agg(F.max("n")).first()[0] / hot_rows)
    marks = [i / parts for i in range(1, parts)] or [1.0]
    place = F.unix_micros(F.col("at").cast("timestamp"))
    bounds = deltas.filter(F.col("key").isin(busy)).groupBy("key").agg(F.percentile_approx(place, marks).alias("bounds"))
    bounds = F.broadcast(materialise(bounds, "slices"))  # for at most TRACKED keys
    number = F.coalesce(F.size(F.filter("bounds", lambda b: b <= place)), F.lit(0))
    number = F.when(F.col("bounds").isNull() | F.col("at").isNull(), 0).otherwise(number).alias("slice")
    cut = lambda rows: rows.join(bounds, "key", "left").select(*rows.columns, number)
    mine = cut(deltas)
    nets = mine.join(bounds.select("key"), "key").groupBy("key", "slice").agg(F.sum("exists").alias("net"))
    slices = bounds.select("key", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("slice"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.join(nets, ["key", "slice"], "left").select(
        "key", F.lit(_CARRIED).alias("phase"), F.lit(None).cast(deltas.schema["at"].dataType).alias("at"),
        F.coalesce(F.sum("net").over(before), F.lit(0)).alias("exists"), "slice",
    )
    return mine.unionByName(carried.filter("exists <> 0")), cut(refs)


def _salted(deltas: DataFrame, refs: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``salt``: references of a hot key are spread, and its existence deltas repeated for each salt."""
    hot = hot_keys(refs, "key", hot_rows=hot_rows)
    if not hot:
        return deltas.withColumn("salt", F.lit(0)), refs.withColumn("salt", F.lit(0))
    kind = refs.schema["key"].dataType.simpleString()
    rows = [(k, math.ceil(n / hot_rows) + 1) for k, n in hot]
    salts = F.broadcast(refs.sparkSession.createDataFrame(rows, f"key {kind}, salts int"))  # at most TRACKED rows
    number = F.coalesce(F.pmod(F.xxhash64("id", "at"), F.col("salts").cast("long")).cast("int"), F.lit(0)).alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    return (
        deltas.join(salts, "key", "left").select(*deltas.columns, every),
        refs.join(salts, "key", "left").select(*refs.columns, number),
    )


def orphan_references(
    facts: DataFrame, refs: Sequence[Reference], *, ident: str, at: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """References whose key did not exist when they were made.

    Returns ``(ref_table, <ident>, key, at)``, one row for each referring record
    and reference, with repeated deliveries of a record folded into one. All
    deltas of a key, of existence and of references, are put in the order of
    time and summed up: a reference is an orphan where the existence count up to
    and including its time is zero. So a record exists from its creation
    (inclusive) to its deletion (exclusive), and overlapping or repeated rows of
    a key add up.

    Null keys refer to nothing and are never orphans. A null ``at`` is met only
    by records that exist always (both times null). An empty referenced table
    makes every reference an orphan; empty facts give an empty result. Only the
    named columns are read, so other columns cannot clash. Records with a null
    ``ident`` are kept, repeated ones folded into one.

    One shuffle for each reference. References of a hot key are salted; the
    changes of a key with very many are cut into slices of time that are summed
    apart. Nothing depends on how far times lie from each other.
    """
    found = []
    for ref in refs:
        deltas = _folded(ref)
        made = reference_deltas(facts, ref, at, ident).select(
            "key", F.when(F.col("at").isNull(), _ALWAYS).otherwise(_TIMED).alias("phase"), "at", "refs", "id"
        )
        deltas, made = _salted(*_sliced(deltas, made, hot_rows), hot_rows)
        kind = made.schema["at"].dataType
        none = F.lit(None).cast(made.schema["id"].dataType)
        order = ["key", "slice", "salt", "phase", "at", "refs", "exists", "id"]
        rows = deltas.withColumns({"at": F.col("at").cast(kind), "refs": F.lit(0).cast("long"), "id": none}).select(*order)
        rows = rows.unionByName(made.withColumn("exists", F.lit(0).cast("long")).select(*order))
        upto = Window.partitionBy("key", "slice", "salt").orderBy("phase", "at", "refs")
        summed = rows.withColumn("existing", F.sum("exists").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        found.append(
            summed.filter("refs > 0 and existing <= 0").select(
                F.lit(ref.name).alias("ref_table"), F.col("id").alias(ident), "key", "at"
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table and month of the reference: ``(ref_table, month, n_orphans, n_keys)``."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_keys")
    )

