import random
from collections import Counter as Tally
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import pytest
import numpy as np
from corvane.llm.cooccurrence import Counter, cooccurrence, tiles


def rows(seed=3):
    """Baskets of skewed items; basket 0 holds a third of all rows."""
    rng = random.Random(seed)
    got = [(b, min(int(rng.paretovariate(0.8)), 60)) for b in range(1, 120) for _ in range(rng.randint(1, 12))]
    got += [(0, i % 70) for i in range(len(got) // 2)]
    return got + got[:50] + [(None, 1), (1, None), (None, None)]


def brute(data, least):
    baskets = defaultdict(set)
    for b, i in data:
        if b is not None and i is not None:
            baskets[b].add(i)
    one, two = Tally(), Tally()
    for items in baskets.values():
        one.update(items)
        two.update(combinations(sorted(items), 2))
    return {(a, b, one[a], one[b], n, len(baskets)) for (a, b), n in two.items() if n >= least}


def found(df, **options):
    options = {"min_count": 1, **options}
    return {tuple(r)[:6] for r in cooccurrence(df, "b", "i", **options).collect()}


@pytest.mark.parametrize(
    "options", [{}, {"wide": 3}, {"max_heavy": 0, "hot_rows": 20}, {"max_heavy": 2, "wide": 5}, {"max_heavy": 0, "wide": 2}]
)
@pytest.mark.parametrize("least", [1, 3, 9])
def test_equals_brute_force(spark, options, least):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], "b int, i int, item string, n_ab int")
    assert found(df, min_count=least, **options) == brute(rows(), least)


def test_share_and_lift(spark):
    df = spark.createDataFrame(rows(), "b int, i int")
    whole = cooccurrence(df, "b", "i", min_share=Fraction(1, 10)).collect()
    assert whole and all(r["n_ab"] * 10 >= r["n_baskets"] and r["item_a"] < r["item_b"] for r in whole)
    r = whole[0]
    assert r["lift"] == pytest.approx(r["n_ab"] * r["n_baskets"] / (r["n_a"] * r["n_b"]))


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, None)], "b string, i bigint")
    assert found(df) == set() and found(df.limit(0)) == set()
    wide = spark.createDataFrame([(1, i) for i in range(30)], "b int, i int")
    assert len(found(wide, min_count=1, wide=4)) == 30 * 29 // 2 and found(wide, min_count=2) == set()


def test_items_of_other_types(spark):
    data = [(b, None if i is None else f"item {i:02d}") for b, i in rows()]
    df = spark.createDataFrame(data, "b int, i string")
    for options in ({}, {"wide": 5, "max_heavy": 3, "hot_rows": 30}):
        got = found(df, min_count=3, **options)
        assert got == brute(data, 3) and all(a < b for a, b, *_ in got)


@pytest.mark.parametrize("limit", [1, 7, 100, 10**6])
@pytest.mark.parametrize("s", [1, 2, 3, 10, 57])
def test_tiles(s, limit):
    parts = list(tiles(s, limit))
    assert [(a, b) for x, y in parts for a, b in zip(x.tolist(), y.tolist(), strict=True)] == list(combinations(range(s), 2))
    assert all(len(x) <= max(limit, s - 1) for x, _ in parts)


def test_a_task_holds_a_bounded_number_of_counts():
    rng = np.random.default_rng(1)
    counter = Counter(np.array([3], np.int64), pairs=2000)
    most, given = 0, []
    for _ in range(60):
        lb = np.repeat(np.arange(20), 15)
        li = np.concatenate([rng.choice(100_000, 15, replace=False) + 10 for _ in range(20)])
        for batch in counter.add(np.arange(20), np.full(20, 3), lb, li, np.ones(20, bool), np.ones(20, bool)):
            given.append(batch)
        most = max(most, counter.held)
    given += counter.result()
    assert most <= 3 * 2000 + 20 * 15 and len(given) > 20
    total = summed(given)
    assert sum(total.values()) == 60 * 20 * (15 * 14 // 2 + 15)


def summed(batches):
    total = defaultdict(int)
    for x in batches:
        for a, b, c in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
            assert a < b
            total[a, b] += c
    return total
