import math
import random

import pytest
from corvane.llm.percentiles import combine, radix_percentiles, sketch, sketch_percentiles
from pyspark.sql import functions as F

PS = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)
NAMES = ("p0", "p25", "p50", "p90", "p99_9", "p100")


def nearest_rank(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values))) - 1]


def groups(rows):
    out = {}
    for g, v in rows:
        if v is not None and v == v:
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize(
    ("kind", "make"),
    [
        ("int", lambda r: r.choice([r.randint(-(2**31), 2**31 - 1), 5, 70_000])),
        ("smallint", lambda r: r.randint(-300, 300)),
        ("bigint", lambda r: r.choice([r.randint(-(2**63), 2**63 - 1), 3])),
        ("double", lambda r: r.choice([r.gauss(0, 1), r.gauss(0, 1e200), 0.0, math.inf, -math.inf, math.nan])),
    ],
)
def test_exact(spark, kind, make):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "hot", "hot"]), make(rng) if rng.random() > 0.05 else None) for _ in range(2000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"s string, v {kind}, g string, code int")
    for period in (None, F.lit("2024-01")):
        found = {r["s"]: r for r in radix_percentiles(df, "v", ["s"], PS, period=period).collect()}
        wanted = groups(rows)
        assert set(found) == set(wanted)
        for g, values in wanted.items():
            assert found[g]["n"] == len(values)
            assert [found[g][c] for c in NAMES] == [nearest_rank(values, p) for p in PS]


def test_months_are_combined_within_the_bound(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b"]), int(rng.paretovariate(0.7)) - 3, rng.randint(1, 3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s string, v int, m int")
    parts = [sketch(df.filter(F.col("m") == m), "v", ["s"], period=F.lit(m), bits=5) for m in (1, 2, 3)]
    for s in (combine(*parts), sketch(df, "v", ["s"], period=F.col("m"), bits=5)):
        for r in sketch_percentiles(s, ["s"], (0.5, 0.99), bits=5).collect():
            values = [v for g, v, _ in rows if g == r["s"]]
            for p, name in ((0.5, "p50"), (0.99, "p99")):
                low, high = r[f"{name}_low"], r[f"{name}_high"]
                assert low <= nearest_rank(values, p) <= high
                assert high - low <= abs(low) * 2**-5 + 1e-300 or low <= 0


def test_empty_nulls_and_no_group(spark):
    df = spark.createDataFrame([(None, None), ("a", None)], "s string, v int")
    assert radix_percentiles(df, "v", ["s"], PS).count() == 0
    assert sketch_percentiles(combine(sketch(df, "v", ["s"])), ["s"], (0.5,)).count() == 0
    one = radix_percentiles(spark.range(1, 101), "id", [], (0.5, 0.9)).collect()
    assert [tuple(r) for r in one] == [(100, 50, 90)]
    with pytest.raises(TypeError):
        radix_percentiles(df, "s", [], (0.5,))
