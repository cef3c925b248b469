"""Top N items within every group, by simultaneous per-group bisection.

A row's rank in its group is an order-preserving code: the score and then the
tie-breaking identifiers, each mapped to an unsigned 64-bit word in which
larger is better. For all groups of a block of rows at once, a cutoff is
bisected word by word: rows at or above the midpoint are counted per group, and
the interval is halved towards the cutoff above which exactly N rows lie.
Nothing is sorted before. Repetitions are looked for among the few rows that
are left, and the cutoff is lowered for groups that fall short without them.

Blocks of rows are cut down to N rows per group before anything is shuffled,
so a group's share of the shuffle is bounded by N rows for each block, however
many rows it has. After the shuffle a task keeps at most N rows of each of its
groups while it takes in more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are cut down together.
BLOCK_ROWS = 500_000

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_FLOATS = (T.FloatType, T.DoubleType)
_TOP = np.uint64(1 << 63)


def ordered_word(column: pa.Array, ascending: bool) -> np.ndarray:
    """An unsigned 64-bit word for each value, larger where the value comes first.

    Integers, booleans, dates and timestamps keep their order by a flipped sign
    bit. Of floats the sign bit is flipped if it is clear, else all bits; -0.0
    equals 0.0 and NaN is greater than every number. Strings become their place
    among the different ones of the block, in the order of their bytes. Nulls
    come last either way.
    """
    nulls = np.asarray(pc.is_null(column))
    if pa.types.is_floating(column.type):
        x = np.array(pc.fill_null(column, 0.0).cast(pa.float64())) + 0.0
        x[np.isnan(x)] = np.nan
        bits = x.view(np.uint64)
        word = np.where(bits >> np.uint64(63) == 1, ~bits, bits | _TOP)
    elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        encoded = pc.fill_null(column, "").dictionary_encode()
        place = np.empty(len(encoded.dictionary), np.uint64)
        place[np.asarray(pc.sort_indices(encoded.dictionary.cast(pa.large_binary())))] = np.arange(len(place), dtype=np.uint64)
        word = place[np.asarray(encoded.indices)] + np.uint64(1)
    else:
        if pa.types.is_date32(column.type):
            column = column.cast(pa.int32())
        ints = column.cast(pa.int64())
        word = np.array(pc.fill_null(ints, 0)).view(np.uint64) ^ _TOP
    if ascending:
        word = ~word
    word = word.copy()
    word[nulls] = 0
    return word


def _cut_rows(rows: np.ndarray, group: np.ndarray, words: Sequence[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Those of ``rows`` that are among the ``want`` best of their group; of rows that tie in all words at the cutoff, one."""
    kept: list[np.ndarray] = []
    n_groups, need = len(want), want.copy()
    for word in words:
        if not len(rows):
            break
        g, value = group[rows], word[rows]
        lo, hi = np.full(n_groups, np.iinfo(np.uint64).max), np.zeros(n_groups, np.uint64)
        np.minimum.at(lo, g, value)
        np.maximum.at(hi, g, value)
        few = np.bincount(g, minlength=n_groups) <= need
        hi[few] = lo[few]  # everything is kept
        above = np.zeros(n_groups, np.int64)  # rows known to lie above the interval
        open_ = np.flatnonzero(lo[g] < hi[g])
        while len(open_):
            og, ov = g[open_], value[open_]
            mid = hi - ((hi - lo) >> np.uint64(1))
            upper = ov >= mid[og]
            at_least = above + np.bincount(og[upper], minlength=n_groups)
            live = lo < hi
            enough, exact = live & (at_least >= need), live & (at_least == need)
            lo = np.where(enough, mid, lo)
            hi = np.where(live & ~enough, mid - np.uint64(1), hi)
            hi[exact] = lo[exact]
            above = np.where(live & ~enough, at_least, above)
            open_ = open_[(upper == enough[og]) & (lo < hi)[og]]
        over, tied = value > lo[g], value == lo[g]
        kept.append(rows[over])
        need = need - np.bincount(g[over], minlength=n_groups)
        whole = np.bincount(g[tied], minlength=n_groups) <= need
        kept.append(rows[tied & whole[g]])
        rows = rows[tied & ~whole[g] & (need > 0)[g]]
    if len(rows):
        kept.append(rows[np.unique(group[rows], return_index=True)[1]])
    return np.concatenate(kept) if kept else rows


def bisect_top(group: np.ndarray, words: Sequence[np.ndarray], n: int, distinct: bool = True) -> np.ndarray:
    """Row numbers of the ``n`` best distinct codes of every group, ascending.

    ``group`` numbers the groups from 0. Of rows with the same group and code
    only the first counts. Unless ``distinct``, groups with at most ``n`` rows
    may keep their repetitions.
    """
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    small = np.flatnonzero((size <= n)[group])
    done = [_first_of_each(small, group, words) if distinct else small]
    rows, want = np.flatnonzero((size > n)[group]), np.full(len(size), n, np.int64)
    while len(rows):
        kept = _cut_rows(rows, group, words, want)
        first = _first_of_each(kept, group, words)
        have = np.bincount(group[first], minlength=len(size))
        short = (have < n) & (want < size)
        done.append(_best(first[~short[group[first]]], group, words, n))
        rows = rows[short[group[rows]]]
        want = np.minimum(2 * want, size)
    return np.sort(np.concatenate(done))


def _sorted(rows: np.ndarray, group: np.ndarray, words: Sequence[np.ndarray]) -> np.ndarray:
    """The rows by group, best codes first, equal ones in their order."""
    return rows[np.lexsort([rows, *(~w[rows] for w in reversed(words)), group[rows]])]


def _first_of_each(rows: np.ndarray, group: np.ndarray, words: Sequence[np.ndarray]) -> np.ndarray:
    """The rows, by group and code, without those whose group and code stood earlier."""
    rows = _sorted(rows, group, words)
    differs = np.ones(len(rows), bool)
    if len(rows):
        differs[1:] = group[rows[1:]] != group[rows[:-1]]
        for w in words:
            differs[1:] |= w[rows[1:]] != w[rows[:-1]]
    return rows[differs]


def _best(rows: np.ndarray, group: np.ndarray, words: Sequence[np.ndarray], n: int) -> np.ndarray:
    """The first ``n`` rows of each group, of rows by group and code."""
    if not len(rows):
        return rows
    g = group[rows]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[place < n]


def _codes(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.dictionary_encode(column, null_encoding="encode").indices, 0)).astype(np.int64)


def _cut(table: pa.Table, n_group: int, n_words: int, ascending: Sequence[bool], n: int, last: bool) -> pa.Table:
    """The table without rows that cannot be among the top ``n`` of their group."""
    if not table.num_rows:
        return table
    columns = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in table.combine_chunks().columns]
    group = np.zeros(table.num_rows, np.int64)
    for i in range(n_group):
        code = _codes(columns[i])
        group = _codes(pa.array(group * (int(code.max()) + 1) + code)) if i else code
    words = [ordered_word(columns[n_group + j], ascending[j]) for j in range(n_words)]
    return table.take(bisect_top(group, words, n, distinct=last))


def top_n(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    n: int,
    *,
    ties: Sequence[tuple[str, bool]] = (),
    keep: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``n`` rows with the highest ``score`` of every group.

    ``ties`` lists the columns that decide between equal scores, each with True
    for ascending; they should identify a row. Rows equal in group, score and
    all ties are one row (repeated deliveries), and the first met is kept.
    Returns the group columns, the score, the ties and ``keep``.

    Rows with a null in a group column or in the score are left out; nulls in a
    tie column come last. NaN scores count as the highest. Groups with fewer
    than ``n`` rows are returned whole; ``n`` of zero or an empty input gives an
    empty result. Score and ties are numbers, booleans, dates, timestamps or
    strings.

    One shuffle, by group, of rows already cut down in blocks of ``block_rows``.
    """
    order = [score, *(c for c, _ in ties)]
    ascending = [False, *(a for _, a in ties)]
    for c in order:
        if not isinstance(df.schema[c].dataType, (*_INTS, *_FLOATS, T.StringType)):
            raise TypeError(f"{c} must be a number, boolean, date, timestamp or string")
    names = [*(f"g{i}" for i in range(len(group))), *(f"w{i}" for i in range(len(order))), *(f"k{i}" for i in range(len(keep)))]
    rows = df.select(*(F.col(c).alias(a) for c, a in zip([*group, *order, *keep], names, strict=True)))
    for c in (*names[: len(group)], "w0"):
        rows = rows.filter(F.col(c).isNotNull())
    n_group, n_words = len(group), len(order)

    def cutter(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            n_held = 0
            limit = block_rows
            for batch in batches:
                held.append(batch)
                n_held += batch.num_rows
                if n_held >= limit:
                    cut = _cut(pa.Table.from_batches(held), n_group, n_words, ascending, n, last)
                    if last:
                        # What is kept counts against the next block only once.
                        held, n_held = cut.to_batches(), cut.num_rows
                        limit = max(block_rows, 2 * n_held)
                    else:
                        yield from cut.to_batches()
                        held, n_held = [], 0
            if held:
                yield from _cut(pa.Table.from_batches(held), n_group, n_words, ascending, n, last).to_batches()

        return run

    if n <= 0:
        kept = rows.limit(0)
    else:
        local = rows.mapInArrow(cutter(False), rows.schema)
        kept = local.repartition(*names[:n_group]).mapInArrow(cutter(True), rows.schema)
    return kept.select(*(F.col(a).alias(c) for a, c in zip(names, [*group, *order, *keep], strict=True)))
