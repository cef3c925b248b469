import math
import random

import numpy as np
import pyarrow as pa
import pytest
from corvane.llm.topn import bisect_top, ordered_word, top_n
from hypothesis import given, settings
from hypothesis import strategies as st


def test_words_keep_the_order():
    values = [-math.inf, -1e300, -2.5, -1e-300, 0.0, 1e-300, 3.0, math.inf, math.nan]
    for kind in (pa.float64(), pa.float32()):
        w = ordered_word(pa.array([v if kind == pa.float64() or abs(v) in (2.5, 3.0) else v for v in values], kind), False)
        assert all(a <= b for a, b in zip(w, w[1:], strict=False))
    ints = [-(2**63), -5, 0, 7, 2**63 - 1]
    assert list(np.argsort(ordered_word(pa.array(ints), False))) == [0, 1, 2, 3, 4]
    assert list(np.argsort(ordered_word(pa.array(ints), True))) == [4, 3, 2, 1, 0]
    assert ordered_word(pa.array([0.0, -0.0]), False).tolist()[0] == ordered_word(pa.array([-0.0]), False)[0]
    assert ordered_word(pa.array([None, -(2**62)]), False)[0] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(0, 3)), max_size=80), st.integers(1, 6))
def test_bisection_equals_sorting(rows, n):
    group = np.array([r[0] for r in rows], np.int64)
    words = [np.array([r[i] for r in rows], np.uint64) for i in (1, 2)]
    kept = bisect_top(group, words, n)
    for g in set(group.tolist()):
        mine = {r[1:] for r in rows if r[0] == g}
        size = sum(r[0] == g for r in rows)
        best = sorted(mine, reverse=True)[:n]
        got = [rows[i][1:] for i in kept if rows[i][0] == g]
        assert set(best) <= set(got) if size <= n else sorted(got, reverse=True) == best


def data(seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, rng.randint(2, 90)]), rng.choice([5, 5, rng.randint(-50, 50)]), rng.randint(0, 4), i) for i in range(3000)]
    return rows + rows[:300] + [(None, 1, 1, 1), (2, None, 1, -1), (3, 100, None, -2)]


@pytest.mark.parametrize("n", [0, 1, 5, 400])
@pytest.mark.parametrize("block", [7, 500_000])
def test_equals_sorting(spark, n, block):
    rows = data()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "u int, s int, t int, i int, g0 string")
    got = sorted(map(tuple, top_n(df, ["u"], "s", n, ties=[("t", True), ("i", True)], block_rows=block).collect()))
    wanted = []
    for u in {r[0] for r in rows if r[0] is not None}:
        mine = {r for r in rows if r[0] == u and r[1] is not None}
        wanted += sorted(mine, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))[:n]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_two_group_columns_floats_and_kept_columns(spark):
    rows = [("a", 1, math.nan, "x"), ("a", 1, 2.0, "y"), ("a", 1, -1.0, "z"), ("a", 2, -0.0, "w"), ("", 1, 1.0, "v"), (None, 1, 1.0, "u")]
    df = spark.createDataFrame(rows, "g string, h int, s double, k string")
    got = sorted(r["k"] for r in top_n(df, ["g", "h"], "s", 2, keep=["k"]).collect())
    assert got == ["v", "w", "x", "y"]
    by_name = top_n(df, ["h"], "s", 9, ties=[("k", False)]).select("h", "k").collect()
    assert len(by_name) == 6
    with pytest.raises(TypeError):
        top_n(spark.createDataFrame([(1, [1])], "g int, s array<int>"), ["g"], "s", 1)


@pytest.mark.parametrize("block", [5, 500_000])
def test_strings_break_ties(spark, block):
    rng = random.Random(2)
    names = ["", "a", "ab", "b", "é", "z", "Z", "a\0", None]
    rows = [(rng.randint(1, 3), rng.randint(0, 2), rng.choice(names)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, s int, k string")
    for ascending in (True, False):
        got = top_n(df, ["g"], "s", 6, ties=[("k", ascending)], block_rows=block).collect()
        for g in (1, 2, 3):
            order = lambda r: (-r[0], r[1] is None, [b if ascending else -b for b in (r[1] or "").encode()] + ([] if ascending else [1]))
            wanted = sorted({r[1:] for r in rows if r[0] == g}, key=order)[:6]
            assert sorted(((r["s"], r["k"]) for r in got if r["g"] == g), key=order) == wanted


def test_repetitions_do_not_crowd_out_others():
    group = np.zeros(10_000, np.int64)
    word = np.repeat(np.arange(10, dtype=np.uint64), 1000)
    assert [int(word[i]) for i in bisect_top(group, [word], 4)] == [6, 7, 8, 9]
    assert len(bisect_top(group, [word], 40)) == 10


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g int, s int"), ["g"], "s", 3).count() == 0
