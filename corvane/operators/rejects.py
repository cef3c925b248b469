"""Rows that fail to parse: CSV lines sorted into valid rows and labelled rejects.

Lines are handled in Arrow batches. Quoting is judged for a whole batch by one
linear-time regular expression, the CSV reader's invalid-row callback labels
the rows with wrong column counts, every field is read as a string, and the
columns are then cast as vectors, which labels the failing cells. Python sees
single rows only where the reader rejects them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.batches import spans

#: A field is a quoted string with spaces around it, or anything without quotes and commas.
_FIELD = r'(?: *"(?:[^"]|"")*" *|[^",]*)'
_SOUND = f"^{_FIELD}(?:,{_FIELD})*$"
#: Spaces outside quotes at both ends of a field.
_SLOPPY = r' *("(?:[^"]|"")*"|[^",]*?) *(,|$)'
_BAD_CHARS = r"[\x00-\x1f]|\x{FFFD}"
#: Bytes of lines that the CSV reader gets at once.
_CHUNK = 32 << 20


@dataclass(frozen=True)
class Field:
    """A column of a delivered file: a 32-bit int, or a string of 1 to ``max_bytes`` UTF-8 bytes."""

    name: str
    max_bytes: int | None = None

    @property
    def is_int(self) -> bool:
        return self.max_bytes is None


Schemas = Mapping[str, Sequence[Field]]


def _good_int(a: pa.Array) -> pa.Array:
    shaped = pc.match_substring_regex(a, r"^-?[0-9]+$")
    bare = pc.replace_substring_regex(a, r"^(-?)0+([0-9])", r"\1\2")
    short = pc.and_(shaped, pc.less_equal(pc.binary_length(bare), 11))
    n = pc.cast(pc.if_else(short, bare, "0"), pa.int64())
    fits = pc.and_(pc.greater_equal(n, -(2**31)), pc.less(n, 2**31))
    return pc.and_(short, fits)


def _good_text(a: pa.Array, max_bytes: int) -> pa.Array:
    size = pc.binary_length(a)
    sized = pc.and_(pc.greater(size, 0), pc.less_equal(size, max_bytes))
    return pc.and_(sized, pc.invert(pc.match_substring_regex(a, _BAD_CHARS)))


# What a line is, by number; the names of the failures.
_VALID, _QUOTING, _COLUMNS, _VALUE, _DESTINATION = range(5)
_REASONS = pa.array([None, "quoting", "columns", "value", "destination"], pa.string())


def _read(lines: pa.Array, width: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Row numbers and string columns of the lines that have ``width`` fields."""
    # A line break inside a line is content. Both kinds become another control
    # character, which fails a cell just as they do.
    clean = pc.replace_substring_regex(lines, r"[\r\n]", "\x01")
    clean = pc.replace_substring_regex(clean, _SLOPPY, r"\1\2")
    names = [f"c{i}" for i in range(width)]
    kept: list[np.ndarray] = []
    parts: list[pa.Table] = []
    for lo, hi in spans(pc.binary_length(clean).to_pylist(), _CHUNK):
        rejected: list[int] = []

        def reject(row: csv.InvalidRow, rejected: list[int] = rejected) -> str:
            rejected.append(row.number - 1)
            return "skip"

        piece = clean.slice(lo, hi - lo)
        body = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece), "\n")[0].as_buffer()
        table = csv.read_csv(
            pa.BufferReader(body),
            read_options=csv.ReadOptions(column_names=names, block_size=len(body) + 1, use_threads=False),
            parse_options=csv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
            convert_options=csv.ConvertOptions(
                column_types={n: pa.string() for n in names},
                strings_can_be_null=False,
                quoted_strings_can_be_null=False,
            ),
        )
        fine = np.ones(hi - lo, bool)
        fine[rejected] = False
        kept.append(np.flatnonzero(fine) + lo)
        parts.append(table)
    if not parts:
        return np.zeros(0, np.int64), [pa.array([], pa.string())] * width
    table = pa.concat_tables(parts).combine_chunks()
    return np.concatenate(kept), [_one(table.column(i)) for i in range(width)]


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


@dataclass
class _Judged:
    """Of some lines: reason and failing cells (as bits) of each, which are valid, and the valid ones' fields one after the other."""

    reason: np.ndarray
    cells: np.ndarray
    valid: np.ndarray
    fields: pa.Array


def _judge(text: pa.Array, fields: Sequence[Field]) -> _Judged:
    """What is wrong with each line (which is no header and not blank)."""
    reason = np.full(len(text), _QUOTING)
    cells = np.zeros(len(text), np.int64)
    sound = np.flatnonzero(np.asarray(pc.match_substring_regex(text, _SOUND)))
    reason[sound] = _COLUMNS
    kept, columns = _read(pc.take(text, pa.array(sound)), len(fields))
    rows = sound[kept]
    for i, (f, c) in enumerate(zip(fields, columns, strict=True)):
        good = np.asarray(_good_int(c) if f.is_int else _good_text(c, f.max_bytes))
        cells[rows[~good]] |= 1 << i
    reason[rows] = np.where(cells[rows] == 0, _VALID, _VALUE)
    ok = np.flatnonzero(cells[rows] == 0)
    place = np.arange(len(fields)) * len(rows) + ok[:, None]
    return _Judged(reason, cells, rows[ok], pc.take(pa.concat_arrays(columns), pa.array(place.ravel())))


def sort_lines(
    lines: DataFrame,
    schemas: Schemas,
    *,
    text: str = "raw_text",
    dest: str = "dest",
    line_no: str = "line_no",
    keep: Sequence[str] = ("line_id", "file_name"),
) -> DataFrame:
    """Judge every delivered line; nothing is lost and nothing is read twice.

    Returns the ``keep`` columns, ``dest``, ``line_no``, ``raw_text``,
    ``reason``, ``bad_cells`` and ``fields`` for all lines but headers (line
    number 1) and blank ones (null, empty or spaces only). ``reason`` is null
    for valid lines, whose unquoted values are in ``fields``; else it is the
    first that applies of ``quoting``, ``columns``, ``value`` (with the failing
    columns in ``bad_cells``), and ``destination`` where ``schemas`` has no such
    table. Null ``line_no`` means an ordinary line, null ``dest`` an unknown one.
    Repeated lines are judged one by one. Lines may be of any length; a batch
    reaches the reader in pieces of bounded size. The work is one pass over the
    input without a shuffle.
    """
    out = T.StructType(
        [*(T.StructField(k, lines.schema[k].dataType) for k in keep)]
        + [
            T.StructField("dest", T.StringType()),
            T.StructField("line_no", T.IntegerType()),
            T.StructField("raw_text", T.StringType()),
            T.StructField("reason", T.StringType()),
            T.StructField("bad_cells", T.StringType()),
            T.StructField("fields", T.ArrayType(T.StringType())),
        ]
    )
    tables = {name: tuple(fields) for name, fields in schemas.items()}
    n_keep = len(keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(n_keep + 2).cast(pa.string())
            dests = batch.column(n_keep)
            n = len(raw)
            reason = np.full(n, _DESTINATION)
            cells = pa.nulls(n, pa.string())
            width, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
            parts, total = [pa.array([], pa.string())], 0
            for name, fields in tables.items():
                at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(dests, name), False)))
                judged = _judge(pc.take(raw, pa.array(at)), fields)
                reason[at] = judged.reason
                failed, which = np.unique(judged.cells, return_inverse=True)
                named = [",".join(f.name for i, f in enumerate(fields) if bits >> i & 1) or None for bits in failed.tolist()]
                mask = np.zeros(n, bool)
                mask[at] = True
                cells = pc.replace_with_mask(cells, pa.array(mask), pc.take(pa.array(named, pa.string()), pa.array(which)))
                width[at[judged.valid]] = len(fields)
                start[at[judged.valid]] = total + len(fields) * np.arange(len(judged.valid))
                parts.append(judged.fields)
                total += len(judged.fields)
            ends = np.cumsum(width)
            place = np.repeat(start, width) + np.arange(ends[-1] if n else 0) - np.repeat(ends - width, width)
            values = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends), pa.int32()),
                pc.take(pa.concat_arrays(parts), pa.array(place)),
                mask=pa.array(reason != _VALID),
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n_keep + 2], raw, pc.take(_REASONS, pa.array(reason)), cells, values], names=out.names
            )

    picked = lines.select(
        *(F.col(k) for k in keep),
        F.col(dest).alias("dest"),
        F.col(line_no).cast("int").alias("line_no"),
        F.col(text).alias("raw_text"),
    )
    wanted = picked.filter("(line_no is null or line_no <> 1) and trim(raw_text) <> ''")
    return wanted.mapInArrow(judge, out)


def valid_rows(judged: DataFrame, fields: Sequence[Field], dest: str, keep: Sequence[str] = ("line_id",)) -> DataFrame:
    """The loaded rows of one table, typed, with the ``keep`` columns in front."""
    got = judged.filter((F.col("dest") == dest) & F.col("reason").isNull())
    typed = [F.col("fields")[i].cast("int" if f.is_int else "string").alias(f.name) for i, f in enumerate(fields)]
    return got.select(*keep, *typed)


def failed_lines(judged: DataFrame) -> DataFrame:
    """The lines that cannot be loaded, as delivered, with the reason and the failing cells."""
    return judged.filter(F.col("reason").isNotNull()).drop("fields")


def reject_report(judged: DataFrame) -> DataFrame:
    """Valid and failed lines of each file and destination, by reason."""
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    why = F.col("reason")
    return judged.groupBy("file_name", "dest").agg(
        count(why.isNull(), "n_valid"),
        count(why == "quoting", "n_quoting"),
        count(why == "columns", "n_columns"),
        count(why == "value", "n_value"),
    )
