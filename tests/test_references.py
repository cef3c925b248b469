import itertools
from datetime import datetime, timedelta

import pytest
from corvane.operators.references import (
    Reference,
    apply_deltas,
    current_orphans,
    existence_deltas,
    orphan_references,
    orphan_report,
    reference_deltas,
)


def day(n):
    return datetime(2024, 1, n)


# key, created, deleted; other columns clash on purpose
OWNERS = [
    (1, None, None), (2, day(5), day(10)), (2, day(15), None), (2, day(15), None), (3, day(9), day(3)), (4, None, day(8)),
    (5, day(8), day(8)), (None, None, None), (6, day(2), day(20)), (6, day(4), day(6)),
]
SCHEMA = "uid int, created_at timestamp_ntz, deleted_at timestamp_ntz"
FACTS = "oid int, uid int, placed_at timestamp_ntz, t int, part int, changes string"


def facts():
    at = [day(4), day(5), day(9), day(10), day(12), day(15), day(25), None]
    rows = [(i, k, t) for i, (k, t) in enumerate(itertools.product([1, 2, 3, 4, 5, 6, 7, None], at))]
    return [(*r, 0, 0, "x") for r in rows + rows[:9]]


def brute(rows):
    def lives(k, t):
        return any(
            u == k and (a is None or (t is not None and a <= t)) and (b is None or (t is not None and t < b))
            for u, a, b in OWNERS
        )

    return sorted({r[0] for r in rows if r[1] is not None and not lives(r[1], r[2])})


@pytest.mark.parametrize("options", [{}, {"hot_rows": 3}, {"hot_rows": 1}, {"hot_rows": 2}])
def test_orphans_as_of_each_reference(spark, options):
    rows = facts()
    table = spark.createDataFrame(OWNERS, SCHEMA)
    found = orphan_references(
        spark.createDataFrame(rows, FACTS), [Reference("users", "uid", table, "uid")], ident="oid", at="placed_at", **options
    )
    assert sorted(r["oid"] for r in found.collect()) == brute(rows)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(OWNERS, SCHEMA)
    orders = spark.createDataFrame(facts(), FACTS)
    all_of = {r[0] for r in facts() if r[1] is not None}
    found = orphan_references(orders, [Reference("users", "uid", none, "uid")], ident="oid", at="placed_at")
    assert {r["oid"] for r in found.collect()} == all_of
    assert orphan_references(orders.limit(0), [Reference("users", "uid", some, "uid")], ident="oid", at="placed_at").count() == 0


@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_a_key_with_very_many_changes_and_far_dates(spark, hot_rows):
    """The number of rows that are sorted is that of the deltas, whatever the times are."""
    start = datetime(2024, 1, 1)
    minute = lambda n: start + timedelta(minutes=n)
    owners = [(7, minute(10 * i), minute(10 * i + 5)) for i in range(1000)] + [(8, datetime(1, 1, 1), datetime(9999, 12, 31))]
    orders = [(i, 7, minute(i)) for i in range(0, 10_000, 3)] + [(20_000, 8, datetime(1, 1, 2)), (20_001, 8, datetime(9999, 12, 31)), (20_002, 7, None)]
    orders += [(30_000 + i, 7, minute(7)) for i in range(300)] + [(40_000 + i, 7, minute(12)) for i in range(300)]
    found = orphan_references(
        spark.createDataFrame(orders, "oid int, uid int, placed_at timestamp_ntz"),
        [Reference("users", "uid", spark.createDataFrame(owners, SCHEMA), "uid")],
        ident="oid", at="placed_at", hot_rows=hot_rows,
    )
    wanted = {i for i in range(0, 10_000, 3) if i % 10 >= 5} | {20_001, 20_002} | {30_000 + i for i in range(300)}
    assert {r["oid"] for r in found.collect()} == wanted


def test_report_by_month(spark):
    orders = spark.createDataFrame([(1, 9, day(1)), (2, 9, day(2)), (3, 8, datetime(2024, 2, 1))], "oid int, uid int, placed_at timestamp_ntz")
    none = spark.createDataFrame([], SCHEMA)
    found = orphan_references(orders, [Reference("users", "uid", none, "uid")], ident="oid", at="placed_at")
    assert sorted(map(tuple, orphan_report(found).collect())) == [("users", "2024-01", 2, 1), ("users", "2024-02", 1, 1)]


def test_ledger_batches_add_up(spark):
    users = spark.createDataFrame(OWNERS, SCHEMA)
    ref = Reference("users", "uid", users, "uid")
    orders = spark.createDataFrame(facts(), FACTS)
    refs, exists = reference_deltas(orders, ref, "placed_at"), existence_deltas(ref)
    whole = apply_deltas(apply_deltas(None, exists), refs)
    other_order = apply_deltas(apply_deltas(apply_deltas(None, refs.filter("key < 3")), exists), refs.filter("key >= 3"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, other_order.collect()))
    assert sorted(r["key"] for r in current_orphans(whole).collect()) == [3, 4, 5, 6, 7]
    back = apply_deltas(whole, refs.withColumn("refs", -refs["refs"]))
    assert current_orphans(back).count() == 0
