"""Items that appear together: supports and lift of item pairs.

Baskets are gathered once and written as rows of item arrays. The frequent
("heavy") items, whose number is bounded by their density, form a dense bit
matrix for each block of baskets, and pairs of them are counted by popcounts of
two rows' conjunction. The others ("light") have short lists of baskets: their
pairs are counted by hashing, and pairs of a light and a heavy item by probing
the matrix at the places of the light item's list. A task adds up its counts
and gives them out whenever they reach a bound, so it needs bounded memory, and
what is shuffled is mostly one row for each pair and task.

A basket with very many light items is never gathered into one row: its light
items are dealt out in parts, each with the basket's heavy items, and pairs of
its light items are looked up only where other baskets support them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.operators.skew import HOT_ROWS, hottest, salted_join
from corvane.storage import materialise

#: An item in at least this share of the baskets is heavy: a bit row is then no larger than its list.
HEAVY_SHARE = 1 / 64
#: At most so many items are heavy; the rest are light, which is exact too.
MAX_HEAVY = 2048
#: A basket with more light items than this is counted only for pairs that other baskets support.
WIDE = 4096
_BLOCK = 8192  # baskets in a bit matrix
_PAIRS = 4_000_000  # pairs counted at once; twice as many counts are held before they are given out
_DENSE = 2048  # light items up to which pair counts are kept in a square table
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def tiles(s: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of range(s), at most ``limit`` at once (or those of one number with all later ones)."""
    lo = 0
    while lo < s - 1:
        sizes = s - 1 - np.arange(lo, min(s - 1, lo + max(1, limit // (s - 1 - lo) * 2)))
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes), limit, side="right")))
        sizes = sizes[: hi - lo]
        a = np.repeat(np.arange(lo, hi), sizes)
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a + 1
        lo = hi


class Counter:
    """Pair counts of one task."""

    def __init__(self, heavy: np.ndarray, pairs: int = _PAIRS):
        self.heavy, self.pairs = heavy, pairs
        self.hh = np.zeros((len(heavy), len(heavy)), np.int64)
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(
        self, hb: np.ndarray, hi: np.ndarray, lb: np.ndarray, li: np.ndarray, first: np.ndarray, narrow: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        """Heavy items ``hi`` of rows ``hb``, light items ``li`` of rows ``lb``, each row's without repetition.

        Pairs of heavy items count in rows that are a basket's ``first``, pairs
        of light ones in ``narrow`` rows.
        """
        n = len(first)
        rows = np.searchsorted(self.heavy, hi)
        if len(rows):
            self._popcount(rows[first[hb]], hb[first[hb]], n)
            if len(li):
                yield from self._probe(rows, hb, lb, li, n)
        yield from self._hash(lb[narrow[lb]], li[narrow[lb]], n)

    def _popcount(self, rows: np.ndarray, cols: np.ndarray, n: int) -> None:
        bits = np.zeros((len(self.heavy), ceil(n / 64) * 64), np.uint8)
        bits[rows, cols] = 1
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in np.unique(rows):
            self.hh[i, i + 1 :] += np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)

    def _probe(self, rows: np.ndarray, cols: np.ndarray, lb: np.ndarray, li: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        present = np.zeros((n, len(self.heavy)), np.uint8)
        present[cols, rows] = 1
        order = np.argsort(li, kind="stable")
        lb, li = lb[order], li[order]
        step = max(1, 4 * self.pairs // len(self.heavy))
        for lo in range(0, len(li), step):
            b, i = lb[lo : lo + step], li[lo : lo + step]
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            counts = np.add.reduceat(present[b], starts, axis=0, dtype=np.int32)
            which, heavy = np.nonzero(counts)
            yield from self._hold(i[starts][which], self.heavy[heavy], counts[which, heavy])

    def _hash(self, lb: np.ndarray, li: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        if not len(li):
            return
        names, code = np.unique(li, return_inverse=True)
        order = np.lexsort((code, lb))
        lb, code = lb[order], code[order].astype(np.int64)
        size = np.bincount(lb, minlength=n)
        first = np.cumsum(size) - size
        k = len(names)
        square = np.zeros(k * k, np.int32) if k <= _DENSE else None
        for s in np.unique(size[size > 1]):
            which = np.flatnonzero(size == s)
            for a, b in tiles(int(s), self.pairs):
                step = max(1, self.pairs // len(a))
                for lo in range(0, len(which), step):
                    m = code[first[which[lo : lo + step], None] + np.arange(s)]
                    key = (m[:, a] * k + m[:, b]).ravel()
                    if square is not None:
                        square += np.bincount(key, minlength=k * k).astype(np.int32)
                    else:
                        key, count = np.unique(key, return_counts=True)
                        yield from self._hold(names[key // k], names[key % k], count)
        if square is not None:
            key = np.flatnonzero(square)
            yield from self._hold(names[key // k], names[key % k], square[key])

    def _hold(self, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(a):
            return
        self.lists.append((np.minimum(a, b), np.maximum(a, b), count.astype(np.int64)))
        self.held += len(a)
        if self.held > 2 * self.pairs:
            yield from self._give()

    def _give(self) -> Iterator[pa.RecordBatch]:
        """Gives out the counts held, equal pairs added up; the shuffle adds up what comes later."""
        if not self.lists:
            return
        a, b, c = (np.concatenate(x) for x in zip(*self.lists, strict=True))
        self.lists, self.held = [], 0
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b, c = a[starts], b[starts], np.add.reduceat(c, starts)
        for lo in range(0, len(a), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part], pa.int64()) for x in (a, b, c)], names=["a", "b", "n_ab"])

    def result(self) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(self.hh)
        yield from self._hold(self.heavy[i], self.heavy[j], self.hh[i, j])
        yield from self._give()


def _pair_counts(baskets: DataFrame, heavy: list[int]) -> DataFrame:
    heavy_items = np.array(sorted(heavy), np.int64)

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(np.asarray(column.offsets))
        return np.repeat(np.arange(len(column)), sizes), np.asarray(column.flatten()).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(heavy_items)
        for batch in batches:
            for lo in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(lo, _BLOCK)
                flags = (np.asarray(part.column(i).cast(pa.int8())).astype(bool) for i in (2, 3))
                yield from counter.add(*lists(part.column(0)), *lists(part.column(1)), *flags)
        yield from counter.result()

    partial = baskets.select("heavy", "light", "first", "narrow").mapInArrow(count, "a long, b long, n_ab long")
    return partial.groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))


def cooccurrence(
    df: DataFrame,
    basket: str,
    item: str,
    *,
    min_count: int = 2,
    min_share: Fraction | None = None,
    wide: int = WIDE,
    max_heavy: int = MAX_HEAVY,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of items with the number of baskets that hold both, and their lift.

    A basket is the set of distinct items of one ``basket`` value. Returns
    ``(item_a, item_b, n_a, n_b, n_ab, n_baskets, lift)`` with ``item_a <
    item_b`` for all pairs in at least ``min_count`` baskets and at least
    ``min_share`` of all baskets; ``lift`` is n_ab * n_baskets / (n_a * n_b),
    1 being what chance gives. Items are integers or of any type with an order.

    Rows with a null basket or item are left out, repeated rows count once, and
    an empty input gives an empty result; other columns are not read. Items in
    fewer baskets than a pair needs are left out before baskets are gathered.
    A basket may hold any number of items: baskets of more than ``wide`` light
    items are fewer than the support asked for (the limit rises until they are),
    so each pair worth counting occurs in another basket, and wide baskets are
    looked up for those pairs only. With ``min_count`` 1 every pair of every
    basket is part of the result, so all of them are made, a bounded number at
    once.
    """
    both = df.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
    # Distinct on both columns: one basket's or item's rows are spread over the tasks.
    pairs = materialise(both.filter("basket is not null and item is not null").distinct(), "pairs")
    by_basket = materialise(pairs.groupBy("basket").agg(F.count(F.lit(1)).alias("n")), "basket_sizes")
    n = by_basket.count()
    least = max(1, min_count, ceil(n * min_share) if min_share else 1)
    code = F.col("item").cast("long") if isinstance(df.schema[item].dataType, _INTS) else F.monotonically_increasing_id()
    single = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).select("item", "n", code.alias("code"))
    single = materialise(single, "items")  # written, so that made-up numbers stay
    frequent = single.filter(F.col("n") >= least)
    # The sum of all frequencies is the number of distinct rows, which bounds this list by density.
    dense = frequent.filter(F.col("n") >= max(2, ceil(n * HEAVY_SHARE))).orderBy(F.desc("n"), "code").limit(max_heavy)
    heavy = [r["code"] for r in dense.select("code").collect()]

    hot = hottest(frequent, "item", hot_rows=hot_rows)
    coded = salted_join(pairs, frequent.select("item", "code"), "item", F.col("basket"), how="inner", hot_rows=hot_rows, hot=hot)
    is_heavy = F.col("code").isin(heavy) if heavy else F.lit(False)
    coded = coded.select("basket", "code", is_heavy.alias("is_heavy"))
    counts = _counted(coded, by_basket, heavy, least, wide)
    supported = counts.filter(F.col("n_ab") >= least)
    of_a = single.select(F.col("code").alias("a"), F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    of_b = single.select(F.col("code").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    named = supported.join(of_a, "a").join(of_b, "b")
    turned = F.col("item_a") > F.col("item_b")  # made-up numbers are in no order
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    return named.select(
        pick("item_a", "item_b", "item_a"),
        pick("item_b", "item_a", "item_b"),
        pick("n_a", "n_b", "n_a"),
        pick("n_b", "n_a", "n_b"),
        "n_ab",
        F.lit(n).cast("long").alias("n_baskets"),
        (F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b").cast("double"))).alias("lift"),
    )


def _counted(coded: DataFrame, by_basket: DataFrame, heavy: list[int], least: int, wide: int) -> DataFrame:
    """``(a, b, n_ab)``: the counts of all pairs that can reach ``least``."""
    if by_basket.filter(F.col("n") > wide).isEmpty():
        return _pair_counts(materialise(_gathered(coded), "baskets"), heavy)
    coded = materialise(coded, "coded")
    sizes = coded.filter("not is_heavy").groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes.filter(F.col("n") > wide), "wide_sizes")
    limit, n_wide = wide, sizes.count()
    while n_wide >= least:  # rises until the baskets beyond it are too few to support a pair alone
        limit *= 2
        n_wide = sizes.filter(F.col("n") > limit).count()
    broad = sizes.filter(F.col("n") > limit).select("basket", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    narrow = coded.join(broad, "basket", "left_anti")
    rows = _gathered(narrow)
    if n_wide:
        broad = materialise(broad.withColumn("number", F.monotonically_increasing_id()), "wide")
        held = materialise(coded.join(broad, "basket"), "wide_items")
        rows = rows.unionByName(_dealt(held))
    counts = _pair_counts(materialise(rows, "baskets"), heavy)
    if not n_wide:
        return counts
    return _add_wide(counts.filter(F.col("n_ab") >= least - n_wide), held.filter("not is_heavy"), n_wide)


def _gathered(coded: DataFrame) -> DataFrame:
    """A row ``(heavy, light, first, narrow)`` for each basket."""
    some = lambda c: F.collect_list(F.when(c, F.col("code")))
    rows = coded.groupBy("basket").agg(some(F.col("is_heavy")).alias("heavy"), some(~F.col("is_heavy")).alias("light"))
    return rows.select("heavy", "light", F.lit(True).alias("first"), F.lit(True).alias("narrow"))


def _dealt(held: DataFrame) -> DataFrame:
    """The rows of wide baskets: their light items in parts, each with all heavy ones, whose number is bounded."""
    heavies = held.filter("is_heavy").groupBy("number").agg(F.collect_list("code").alias("heavy"))
    part = F.pmod(F.xxhash64("code"), F.col("parts").cast("long"))
    lights = held.filter("not is_heavy").groupBy("number", part.alias("part")).agg(F.collect_list("code").alias("light"))
    first = F.row_number().over(Window.partitionBy("number").orderBy("part")) == 1
    rows = lights.withColumn("first", first).join(heavies, "number", "left")
    none = F.array().cast("array<bigint>")
    return rows.select(F.coalesce("heavy", none).alias("heavy"), "light", "first", F.lit(False).alias("narrow"))


def _add_wide(counts: DataFrame, held: DataFrame, n_wide: int) -> DataFrame:
    """Adds to the pairs of light items the wide baskets that hold both, as bits: one for each of ``n_wide`` baskets."""
    ids = held.select("number").distinct()
    place = Window.orderBy("number")  # fewer baskets than the support asked for, one row each
    numbered = materialise(ids.withColumn("bit", F.row_number().over(place) - 1), "wide_bits")
    rows = held.join(numbered, "number").select("code", (F.col("bit") / 64).cast("int").alias("word"), F.pmod("bit", F.lit(64)).alias("bit"))
    words = rows.groupBy("code", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    maps = words.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    zero = F.lit(0).cast("long")
    dense = F.transform(F.sequence(F.lit(0), F.lit((n_wide - 1) // 64)), lambda w: F.coalesce(F.try_element_at("m", w), zero))
    lists = materialise(maps.select("code", dense.alias("bits")), "wide_lists")
    a = lists.select(F.col("code").alias("a"), F.col("bits").alias("in_a"))
    b = lists.select(F.col("code").alias("b"), F.col("bits").alias("in_b"))
    shared = F.aggregate(F.zip_with("in_a", "in_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    return (
        counts.join(a, "a", "left")
        .join(b, "b", "left")
        .select("a", "b", (F.col("n_ab") + F.coalesce(shared, F.lit(0))).cast("long").alias("n_ab"))
    )
